"""Personal data in sentences written apart from the composed training texts."""

from __future__ import annotations

import pytest

from postsieve.llm import pii

#: (text, [(type, datum)]), in six languages.
SENTENCES = [
    ("Our accountant, Margaret Thistlewood, retired last spring.", [("name", "Margaret Thistlewood")]),
    ("The keynote was given by Rajesh Balakrishnan and nobody wanted to leave.", [("name", "Rajesh Balakrishnan")]),
    ("I still owe Danny Okafor twenty pounds for the concert.", [("name", "Danny Okafor")]),
    ("Yesterday Priscilla Nakamura won the chess tournament again.", [("name", "Priscilla Nakamura")]),
    ("Forward the minutes to Halloran, Deirdre before noon.", [("name", "Halloran, Deirdre")]),
    ("It was Walter J. Pemberton who found the old map.", [("name", "Walter J. Pemberton")]),
    ("Honestly, Tobias Lindqvist's cooking is better than mine.", [("name", "Tobias Lindqvist")]),
    ("The lawsuit names Carla Espinoza as a witness.", [("name", "Carla Espinoza")]),
    ("Rückfragen bitte an Sabine Krüger richten.", [("name", "Sabine Krüger")]),
    ("Gestern hat Thorsten Wiegand den Schlüssel abgegeben.", [("name", "Thorsten Wiegand")]),
    ("Der Vortrag von Annegret Hollmann war viel zu lang.", [("name", "Annegret Hollmann")]),
    ("La semaine dernière, Bertrand Lacombe a quitté l'entreprise.", [("name", "Bertrand Lacombe")]),
    ("Le dossier est suivi par Mme Solange Perrault depuis mai.", [("name", "Solange Perrault")]),
    ("El informe lo firmó Rodrigo Villanueva ayer por la tarde.", [("name", "Rodrigo Villanueva")]),
    ("La doctora Beatriz Montalvo atiende los martes.", [("name", "Beatriz Montalvo")]),
    ("O contrato foi assinado por Gustavo Figueiredo na sexta-feira.", [("name", "Gustavo Figueiredo")]),
    ("A vizinha, Leonor Carvalho, tem três gatos.", [("name", "Leonor Carvalho")]),
    ("Volgens Marloes Dijkstra was de vergadering al afgelopen.", [("name", "Marloes Dijkstra")]),
    ("Stuur de rekening maar naar Gerrit Hoekstra.", [("name", "Gerrit Hoekstra")]),
    ("If anything breaks during the night, ring 0161 496 0822 and wait.", [("phone", "0161 496 0822")]),
    ("The plumber left a card: (415) 555-0117.", [("phone", "(415) 555-0117")]),
    ("New number since Monday, it's +44 7700 900613.", [("phone", "+44 7700 900613")]),
    ("Texts only please, 07700 900245, I never pick up.", [("phone", "07700 900245")]),
    ("Sie erreichen mich unter 0171 2345678 ab acht Uhr.", [("phone", "0171 2345678")]),
    ("Die Praxis ist unter 030/2345678 zu erreichen.", [("phone", "030/2345678")]),
    ("Rückruf erbeten: +49 89 1234567", [("phone", "+49 89 1234567")]),
    ("Vous pouvez me joindre au 06 12 34 56 78 le soir.", [("phone", "06 12 34 56 78")]),
    ("Le standard répond au +33 1 45 67 89 10.", [("phone", "+33 1 45 67 89 10")]),
    ("Mi móvil nuevo es el 612 345 678, apúntalo.", [("phone", "612 345 678")]),
    ("Llámame al +34 911 234 567 cuando llegues.", [("phone", "+34 911 234 567")]),
    ("O meu contacto é o +351 912 345 678.", [("phone", "+351 912 345 678")]),
    ("Je kunt me bellen op 06-12345678 na zessen.", [("phone", "06-12345678")]),
    ("Bij spoed: 020 123 4567, dag en nacht.", [("phone", "020 123 4567")]),
    ("He typed his social security number 219-09-9999 into the chat.", [("id_number", "219-09-9999")]),
    ("Her passport, number C03005988, expired in May.", [("id_number", "C03005988")]),
    ("They wanted my driving licence 84736251 as proof.", [("id_number", "84736251")]),
    ("National insurance number QQ 12 34 56 C was on the envelope.", [("id_number", "QQ 12 34 56 C")]),
    ("Meine Ausweisnummer lautet T22000129.", [("id_number", "T22000129")]),
    ("Der Reisepass mit der Nummer C01X0006H wurde gefunden.", []),
    ("Bitte die Steuer-ID 12345678901 angeben.", [("id_number", "12345678901")]),
    ("Mon passeport 07CK12345 est périmé.", []),
    ("Su DNI es 12345678Z y vive aquí.", [("id_number", "12345678Z")]),
    ("El NIE X1234567L no aparece en la lista.", [("id_number", "X1234567L")]),
    ("O meu NIF é 245367891, preciso de fatura.", [("id_number", "245367891")]),
    ("Vul uw BSN 123456782 in op de tweede pagina.", [("id_number", "123456782")]),
    ("Paspoortnummer NM1234567 hoort bij deze aanvraag.", [("id_number", "NM1234567")]),
    ("We finally moved into 47 Larchmont Avenue last week.", [("address", "47 Larchmont Avenue")]),
    ("The van is parked outside 9b Saltmarsh Lane.", [("address", "9b Saltmarsh Lane")]),
    ("Somebody reported smoke at 212 Old Mill Road.", [("address", "212 Old Mill Road")]),
    ("Leave the keys with the neighbour, 3 Copper Beech Close.", [("address", "3 Copper Beech Close")]),
    ("Die Werkstatt ist in der Lindenstraße 14a.", [("address", "Lindenstraße 14a")]),
    ("Wir treffen uns vor dem Haus am Rosenweg 7.", [("address", "Rosenweg 7")]),
    ("Treffpunkt ist die Goethestr. 112", [("address", "Goethestr. 112")]),
    ("Elle loue un studio au 18 rue des Lilas.", [("address", "18 rue des Lilas")]),
    ("Le colis est resté au 5 avenue Victor Hugo.", [("address", "5 avenue Victor Hugo")]),
    ("Vivimos en la calle Mayor 22 desde enero.", [("address", "calle Mayor 22")]),
    ("A loja fica na rua das Flores, 38.", [("address", "rua das Flores, 38")]),
    ("De winkel zit op de Prinsengracht 263.", [("address", "Prinsengracht 263")]),
    ("Haar kamer is aan de Kerkstraat 51b.", [("address", "Kerkstraat 51b")]),
    ("Complaints go to service.desk@harbourmail.example, nobody reads them.", [("email", "service.desk@harbourmail.example")]),
    ("my old address j_ferris88@inbox.test no longer works", [("email", "j_ferris88@inbox.test")]),
    ("drop a line at k.osei [at] fastpost [dot] org", [("email", "k.osei [at] fastpost [dot] org")]),
    ("Meine Adresse lautet birgit-wolff(at)posteo(dot)de.", [("email", "birgit-wolff(at)posteo(dot)de")]),
    ("Bewerbungen an karriere@werkstatt.example schicken", [("email", "karriere@werkstatt.example")]),
    ("Écrivez-moi sur luc.martin+jeux@courrier.example", [("email", "luc.martin+jeux@courrier.example")]),
    ("Mándame las fotos a pilar.gz@correo.example por favor", [("email", "pilar.gz@correo.example")]),
    ("Responde para joana.reis @ sapo.example ainda hoje", [("email", "joana.reis @ sapo.example")]),
    ("Mailen kan via t.devries at webpost dot nl", [("email", "t.devries at webpost dot nl")]),
    ("reply to anna_k99 at mailbox dot org if you want it", [("email", "anna_k99 at mailbox dot org")]),
]
HARMLESS = [
    "The Grand Hotel on Baker Street was fully booked.", "We flew from New York to San Francisco in March.", "Manchester United lost to the Boston Red Sox, of all teams.", "Happy Birthday and Merry Christmas to everyone!", "My order 4839201775 has still not arrived.", "Version 10.4.22 crashes on start.",
    "The score was 21-14 after 90 minutes.", "ISBN 978-3-16-148410-0 is the second edition.", "It happened between 1998 and 2004.", "Tickets cost 1,250.00 for 12 people.", "The meeting is at 14:30 on 03.11.2024.", "Anna and Peter came by on Sunday.", "Schöne Grüße aus dem Schwarzwald!", "Der Deutsche Bundestag hat gestern getagt.",
    "Guten Morgen zusammen, der Zug fällt aus.", "La Tour Eiffel est fermée le lundi.", "Le Monde Diplomatique publie un article.", "La Sagrada Familia sigue en obras.", "O Rio Douro passa no Porto.", "De Nederlandse Spoorwegen staken weer.", "Please read Chapter 12, page 304.", "Flight BA2490 leaves from gate 17.", "I walked 12 miles down the road.",
    "@MargaretT posted this at 9:41 and deleted it.", "Parcel RR473829104 left the depot.", "Look at example.com for the schedule.", "THIS IS NOT A DRILL, EVERYBODY OUT NOW", "The Quick Brown Fox Jumps Over The Lazy Dog",
]


@pytest.fixture(scope="module")
def finder():
    return pii.Model()


def test_data_in_sentences_written_apart(finder):
    texts = [*SENTENCES, *((t, []) for t in HARMLESS)]
    assert len(SENTENCES) >= 60
    found = [{(pii.TYPES[k], t[s:e]) for k, s, e, _ in spans} for (t, _), spans in zip(texts, finder.select([t for t, _ in texts]))]
    for kind in pii.TYPES:
        want = sum(x[0] == kind for _, w in texts for x in w)
        both = sum(x[0] == kind and x in got for (_, w), got in zip(texts, found) for x in w)
        have = sum(x[0] == kind for got in found for x in got)
        assert both >= 0.9 * want and both >= 0.9 * have, (kind, want, have, both)

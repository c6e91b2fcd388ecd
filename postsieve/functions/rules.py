"""Rule tables of the screening and labelling operators.

Fixed values: patterns, categories, orders, scores and names that the results
must agree on. ``\\b`` in a pattern is a Unicode word boundary; see text.bounded.
"""

from __future__ import annotations

#: Moderation rules, in order.
MODERATION = {
    "self_harm": [
        r"\b(kms|ctb)\b",
        r"\b(kill\s+myself|end\s+it\s+all|not\s+worth\s+living)\b",
        r"\b(self[\s\-]?harm|cut\s+myself|hurt\s+myself|suicid(e|al))\b",
    ],
    "threats": [
        r"\b(i\s*(will|['’]?ll)\s*(kill|hurt|shoot|stab))\b",
        r"\b(death\s+threat)\b",
        r"\brip\s+your\b",
    ],
    "violence": [
        r"\b(murder|shoot|stab|execute|slaughter|bloodbath|assault)\b",
        r"\b(rape|sexual\s+assault|gang\s+rape)\b",
    ],
    "sexual": [
        r"\b(porn|pornography|sex\s*tape|sex\s*video|xxx|nsfw)\b",
        r"\b(nude|naked|topless|onlyfans)\b",
        r"\b(blowjob|orgasm|masturbat|creampie)\b",
    ],
    "hate": [
        r"\b(racist|racism|homophobic|transphobic|antisemitic|islamophobic|xenophobic)\b",
        r"\b(supremacist|nazi|klan)\b",
        r"\bslur\b",
    ],
    "harassment": [
        r"\b(doxx?|swat(ting)?|stalking|harass(ment)?|cyberbully(ing)?)\b",
        r"\b(raid|cancel|expose)\b",
    ],
    "spam": [
        r"\b(click\s+here|buy\s+now|limited\s+offer|make\s+money\s+fast|act\s+now)\b",
    ],
}
#: Categories of a coded term's meaning; the first that matches counts.
MEANINGS = {
    "self_harm": r"\b(suicide|suicidal|self[\s\-]?harm|kill\s+myself)\b",
    "violence": r"\b(kill|murder|shoot|stab|rape|assault|blood)\b",
    "sexual": r"\b(porn|sex|nude|naked|onlyfans|xxx|nsfw)\b",
    "hate": r"\b(nazi|klan|racis(t|m)|antisemit|homophob|transphob|slur)\b",
    "drugs": r"\b(weed|coke|heroin|opioid|meth|fentanyl|drug)\b",
}
#: Worst first, and the categories that moderate a post.
SEVERITY = ["self_harm", "threats", "violence", "sexual", "hate", "harassment", "spam"]
MODERATED = ["self_harm", "threats", "violence", "sexual", "hate"]

#: The answers a model may give.
ANSWERS = ["yes", "no", "unsure"]
DOMAINS = ["sexual", "violence", "self_harm", "drugs", "hate", "profanity", "politics", "platforms", "commerce", "health", "other", "none"]
MECHANISMS = ["euphemism", "emoji_sub", "leetspeak", "masking", "spacing", "homograph", "initialism", "phonetic", "other"]
REVIEW_BELOW = 0.65

#: Endings that make a text look like a bare address, and the shares that decide.
DOMAIN_ENDINGS = r"(?i)\.(com|org|net|io|co|uk|tv|info|edu|gov)"
MAX_URL_SIGNS, MAX_SYMBOLS, LEAST_CHARS = 0.4, 0.7, 4

#: Leading columns of a label export.
EXPORT_COLUMNS = ["hash", "text", "is_coded", "domain", "mechanism", "confidence", "spans", "decoded", "reasoning", "needs_review", "model_used"]

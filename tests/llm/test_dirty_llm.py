"""Every query of this subpackage on dirty and on empty tables."""

from __future__ import annotations

import pytest

from postsieve.llm.queries import QUERIES

from .. import dirty


@pytest.fixture(scope="module", params=["dirty", "empty"])
def folder(request, sf, tmp_path_factory):
    return dirty.write(sf, tmp_path_factory.mktemp(request.param), request.param == "dirty")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_does_not_fail(spark, folder, name):
    assert QUERIES[name](spark, folder).count() >= 0

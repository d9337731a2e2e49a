"""Hand-made cases: what each gives, row by row."""

import pytest

from .golden import CASES


@pytest.mark.parametrize("name", list(CASES))
def test_case(spark, name):
    run, columns, expected = CASES[name]
    found = run(spark, "")
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(expected, key=str)

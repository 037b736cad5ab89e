"""The driver contract and rules that hold for the whole package."""

from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__ as contract
from hubflow.catalog import CHECKS

ROOT = Path(contract.__file__).parent


def test_entry_returns_a_lazy_result(spark):
    result = contract.entry(spark)
    assert result.columns[:3] == ["week_start", "deli_province", "externallane"]
    assert result.count() > 0


def test_every_query_has_a_statement():
    def own(found):
        return {name for name in found if not re.match(r"op\d+_|pipeline$", name)}

    assert own(contract.queries()) == own(contract.oracle_sql()) == set(CHECKS)


def test_inventory_is_complete():
    names = set(CHECKS)
    for letter, count in (("r", 10), ("d", 47)):
        for number in range(1, count + 1):
            assert any(n.startswith(f"{letter}{number:02d}_") for n in names), (letter, number)


def test_operators_never_leave_the_cluster():
    banned = re.compile(r"\.(collect|toPandas|toLocalIterator|crossJoin|localCheckpoint|rdd|limit|sample|coalesce)\b\(?")
    allowed = re.compile(r"F\.coalesce|limit_")
    for path in (p for p in (ROOT / "hubflow").rglob("*.py") if "llm" not in p.parts):
        for line in path.read_text().splitlines():
            assert not banned.search(allowed.sub("", line)), (path, line)

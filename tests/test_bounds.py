"""Every plain condition of a report must matter: without any one of them its check statement has to give other rows.

Reports equal their statements (``test_oracle.py``), so a report that forgets such a condition differs from its check.
"""

from __future__ import annotations

import re

import pytest

from hubflow.catalog.reports import REPORTS
from hubflow.sources.samples import with_views
from verify import connect

LITERAL = r"(?:DATE |TIMESTAMP )?'[^']*'|[0-9]+"
COLUMN = r'(?<![\w."])(?:\w+\.)?(?:"\w+"|[a-z_][a-z0-9_]*)'
#: Comparisons of a column, or of its day, with literals. Text columns hold what the views give them, so views are not searched.
CONDITION = re.compile(
    rf"(?:CAST\({COLUMN} AS DATE\)|{COLUMN}) (?:(?:=|<>|<=|>=|<|>) (?:{LITERAL})|BETWEEN (?:{LITERAL}) AND (?:{LITERAL})"
    rf"|(?:NOT )?IN \((?:{LITERAL})(?:, *(?:{LITERAL}))*\)|(?:NOT )?LIKE '[^']*'|IS NOT NULL)"
)
#: Conditions that no data can tell apart in a report, with the reason.
_IMPLIED = {
    "currentstatus IN ('delivered', 'returned')": "other orders have no completion time",
    "order_code IS NOT NULL": "rows without an order join nothing",
    "location_id IN ('1626', '21365000')": "weights count at these hubs only",
}
IDLE = {(name, text): reason for name in ("r09_weight_gap_summary", "r10_weight_gap_detail") for text, reason in _IMPLIED.items()}


@pytest.fixture(scope="module")
def con():
    return connect("/root/testdata/sf0.01")


def without_one(statement):
    """The statement without each of its conditions in turn; a range loses its ends one by one."""
    for found in CONDITION.finditer(statement):
        text, instead = found.group(), ["TRUE"]
        if "BETWEEN" in text:
            column, ends = text.split(" BETWEEN ")
            low, high = ends.split(" AND ")
            instead = [f"{column} >= {low}", f"{column} <= {high}"]
        for other in instead:
            yield text, statement[: found.start()] + other + statement[found.end() :]


def rows(con, statement):
    return sorted(map(str, con.execute(with_views(statement)).fetchall()))


@pytest.mark.parametrize("name", list(REPORTS))
def test_each_condition_of_a_report_changes_rows(con, name):
    statement = REPORTS[name].sql
    expected, idle, tried = rows(con, statement), [], 0
    for text, other in without_one(statement):
        tried += 1
        if (name, text) not in IDLE and rows(con, other) == expected:
            idle.append(text)
    assert tried and not idle

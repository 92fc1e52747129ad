"""COVERAGE.md against the registry and the inventory."""

from __future__ import annotations

import os
import re

from retrix.plans.catalogue import ORACLE, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TEXT = open(os.path.join(ROOT, "COVERAGE.md"), encoding="utf-8").read()


def test_every_query_is_in_the_map_and_marked_if_it_has_no_sql():
    named = set(re.findall(r"[a-z][a-z0-9_]+", TEXT))
    assert set(QUERIES) <= named
    marked = {x for x in re.findall(r"([a-z][a-z0-9_]+)†", TEXT)}
    assert {x for x in marked if x in QUERIES} == set(QUERIES) - set(ORACLE)


def test_every_row_of_the_inventory_is_in_the_map():
    found = set()
    for first, last in re.findall(r"(\d+)(?:–(\d+))?", TEXT):
        found |= set(range(int(first), int(last or first) + 1))
    assert set(range(1, 467)) <= found

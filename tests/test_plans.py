"""Plans made at the same time, and only those that a query wants."""

import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest

from rootspan import shipping
from rootspan.config import StaticConfig
from rootspan.plans import catalogue
from rootspan.plans.static import run_static
from rootspan.sources.triples import triples_of
from rootspan.streaming import evolve

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, plans", [("move_insert", 1), ("move_delete", 1), ("move_gain", 2)])
def test_only_wanted_plans(spark, monkeypatch, name, plans):
    made = []
    none = spark.createDataFrame([], "v bigint, part int")
    monkeypatch.setattr(catalogue.evolve, "initial_plan", lambda triples, config: made.append(1) or SimpleNamespace(vertex_part=none, triples=triples))
    assert catalogue.QUERIES[name](spark, SMALL).columns == ["part", "s", "p", "o"]
    assert len(made) == plans


def test_package_is_sent_once():
    sent = []
    context = SimpleNamespace(applicationId="threads", addPyFile=lambda path: time.sleep(0.2) or sent.append(path))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(shipping.ship, [SimpleNamespace(sparkContext=context)] * 2))
    assert len(sent) == 1


def test_subjects_are_enough_for_triples(spark):
    triples = triples_of(spark, [(1, 1, 2), (2, 1, 3), (4, 1, 3), (4, 1, 5)])
    whole, part = (evolve.initial_plan(triples, StaticConfig(k=2, only_subjects=only)) for only in (False, True))
    assert {r["v"] for r in whole.vertex_part.collect()} == {1, 2, 3, 4, 5}
    assert {r["v"] for r in part.vertex_part.collect()} == {1, 2, 4}
    assert sorted(map(tuple, part.placed.collect())) == sorted(map(tuple, whole.placed.collect()))
    with pytest.raises(ValueError):
        evolve.evolve(part, spark.createDataFrame([], "is_insert boolean, s bigint, p bigint, o bigint"))


def test_text_is_parsed_once(spark, tmp_path):
    (tmp_path / "input").write_text("1 1 2\n2 1 3\n")
    plan = run_static(spark, StaticConfig(k=2, input=str(tmp_path / "input")))
    assert "regexp" not in plan.placed._jdf.queryExecution().optimizedPlan().toString().lower()

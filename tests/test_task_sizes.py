"""What one task holds must not grow with the tables."""

from __future__ import annotations

from kpiscope.plans import inputs, on_graph
from kpiscope.sources import tables


def test_tasks_of_the_panel_follow_the_event_log(spark, sf, monkeypatch):
    """Hours of gaps are many times the rows that a task reads, so tasks are not merged by what they read."""
    n = tables.load(spark, sf, "events").count()
    monkeypatch.setattr(tables, "EVENTS_PER_TASK", n // 20)
    for df in (inputs.panel(spark, sf), inputs.timeline(spark, sf)):
        assert df.rdd.getNumPartitions() >= 20


def test_deduplication_moves_only_used_columns(spark, sf, capsys):
    on_graph.kg_node_type(spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "aligned_name" in plan
    assert not any(c in plan.split("Window")[-1] for c in ("raw_text", "integrate_score", "min_pct_source", "mechanism"))


def test_long_sections_reach_python_few_at_a_time(spark, sf, capsys):
    """A batch of Arrow holds ten thousand bodies and their parts, whatever their length."""
    from kpiscope.plans import on_text

    on_text.tx_split_long(spark, sf).explain()
    plan = capsys.readouterr().out
    assert "ArrowEvalPython" not in plan
    assert plan.count("BatchEvalPython") == 1

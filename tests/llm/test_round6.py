"""What the spelling variants send to the driver and all tasks."""

from __future__ import annotations

from sequor.llm import common, spelling


def test_no_join_of_words_or_keys_is_a_broadcast(spark, monkeypatch):
    words = spark.range(3000).selectExpr("id", "concat('word', lpad(cast(id as string), 5, '0')) as word", "id + 1 as n")
    table = common.Stash(words)
    plan = spelling.near_pairs(table.df)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3
    table.drop()

    plans, stored = [], spelling.cut

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(spelling, "cut", cut)
    # n: 1, 5, 25, ...: a chain of forms, so that there are rounds.
    chain = spark.range(6).selectExpr("concat(repeat('a', cast(id as int)), 'bcdefg') as word", "cast(pow(5, id) as long) as n")
    assert {r.root for r in spelling.group_variants(chain).collect()} == {"aaaaabcdefg"}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)

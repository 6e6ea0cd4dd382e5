"""The query answer_batch returns whole prompts, not only their first 200 characters."""


def test_whole_prompts(spark, sf):
    from chunkloom.plans import bridges, catalog

    asked = {r.question_id: r.question for r in bridges.questions(spark, sf).collect()}
    rows = catalog.queries()["answer_batch"](spark, sf).collect()
    assert {r.question_id for r in rows} == set(asked) and any(len(r.prompt) > 203 for r in rows)
    assert all(asked[r.question_id] in r.prompt for r in rows)
    assert all(r.prompt_preview == (r.prompt[:200] + "..." if len(r.prompt) > 200 else r.prompt) for r in rows)

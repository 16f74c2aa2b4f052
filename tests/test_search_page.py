"""Pages behind a cursor against pages by number."""

import random

import pytest

from vouch.operators.ranking import page_key, search_page


def results(spark):
    rng = random.Random(2)
    rows = [(f"b{i:03}", rng.choice(["ada", "bo", None]), rng.choice(["پ", None]),
             rng.choice([0.5, 0.25, None]), rng.choice([43.5, 43.7, None]), -79.4) for i in range(90)]
    return spark.createDataFrame(rows, "business_id string, name_latin string, name_fa string, "
                                       "score double, lat double, lng double")


@pytest.mark.parametrize("sort", ["confidence", "name", "distance"])
def test_pages_behind_a_cursor_equal_numbered_pages(spark, sort):
    df, where = results(spark), dict(lat=43.6, lng=-79.0)
    key, after, seen = page_key(sort, **where), None, []
    for number in (1, 2, 3, 4):
        page = search_page(df, sort, 1, 25, after=after, **where)
        rows = page.select("business_id", key.alias("cursor")).collect()
        assert [r.business_id for r in rows] == [
            r.business_id for r in search_page(df, sort, number, 25, **where).collect()]
        seen += [r.business_id for r in rows]
        after = tuple(rows[-1].cursor)
    assert len(seen) == len(set(seen)) == 90
    assert search_page(df, sort, 1, 25, after=after, **where).isEmpty()


def test_a_late_page_skips_nothing_in_one_task(spark):
    df = results(spark)
    plan = search_page(df, "confidence", 1, 25, after=(False, -0.5, False, "ada", "b050"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=25" in text and "offset" not in text.lower()
    with pytest.raises(ValueError):
        page_key("distance")

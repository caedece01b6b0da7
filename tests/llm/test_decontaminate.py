import pytest

from fraudlens.llm import decontaminate

from . import fixtures as Fx

ITEM = "If Anna buys 12 apples at 3 dollars each and gives Anna's brother Bob 4 apples how many apples remain with her"


@pytest.mark.parametrize("few", [0, 200_000])
def test_templates(spark, few):
    bench = spark.createDataFrame([(7, ITEM), (8, "short one"), (9, None), (10, "exactly five plain words here")], "item_id long, text string")
    texts = {
        1: f"noise before {ITEM} and after",
        2: "x " + ITEM.replace("12", "90").replace("3 dollars", "8 euros").replace("Anna", "Clara").replace("Bob", "Dan"),
        3: ITEM.upper(),
        4: "if anna sells pears and gives nothing away then how could there be any left at all",
        5: "short one",
        6: "so: exactly, five plain words here!",
        7: None,
        8: "",
    }
    docs = Fx.frame(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])
    out = {r.doc_id: r for r in decontaminate.judge(docs, bench, broadcast_rows=few).collect()}
    assert {i for i, r in out.items() if r.contaminated} == {1, 2, 3, 6}
    assert out[1].first_item == 7 and out[6].first_item == 10
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [4, 5, 7, 8]


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(1, "we give 5 to him and take 5 from her now")], "item_id long, text string")
    docs = Fx.frame(spark, [(1, "we give 9 to him and take 9 from her now", "en", "s", 0), (2, "we give 9 to him and take 8 from her now", "en", "s", 0)])
    out = {r.doc_id: r.contaminated for r in decontaminate.judge(docs, bench, width=10).collect()}
    assert out == {1: True, 2: False}


def test_empty_benchmark(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.judge(Fx.frame(spark), bench).collect())

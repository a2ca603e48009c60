import pytest

from quillgraph.functions import paths
from quillgraph.functions.ids import find_ids, node_kind
from quillgraph.functions.stem import english, russian, stem
from quillgraph.functions.tokens import query_tokens


@pytest.mark.parametrize(
    "text, ids",
    [
        ("FR-RPT-42…48", [f"FR-RPT-{n}" for n in range(42, 49)]),
        ("R-1601…R-1603", ["R-1601", "R-1602", "R-1603"]),
        ("INV-11/12/20", ["INV-11", "INV-12", "INV-20"]),
        ("FR-RPT-48…42", ["FR-RPT-48"]),
        ("FR-A-1..99", ["FR-A-1"]),
        ("XFR-PAY-22Y 2026-09-06 B1", []),
        ("BE-M02 T25, PLAT-M01", ["BE-M02", "PLAT-M01"]),
        ("", []),
        (None, []),
    ],
)
def test_find_ids(text, ids):
    assert [i for i, _ in find_ids(text)] == ids


def test_node_kinds():
    assert [node_kind(i) for i in ("INV-1", "ADR-004", "BE-M01", "FR-PAY-1")] == ["Invariant", "Adr", "Milestone", "Requirement"]


@pytest.mark.parametrize(
    "word, stemmed",
    [
        ("consistently", "consist"), ("consolation", "consol"), ("knightly", "knight"), ("knots", "knot"), ("skies", "sky"), ("dying", "die"),
        ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("national", "nation"), ("happy", "happi"), ("by", "by"),
        ("relational", "relat"), ("falling", "fall"), ("controlled", "control"), ("ties", "tie"), ("cries", "cri"), ("agreed", "agre"),
    ],
)
def test_english(word, stemmed):
    assert english(word) == stemmed


def test_stems_agree():
    assert stem("cancellations") == stem("cancellation")
    assert stem("штрафа") == stem("штрафы")
    assert stem("отмены") == stem("отмена")
    assert russian("важная") == "важн" and russian("бегавшая") == russian("бегавший")
    assert stem("fr-pay-1") == "fr-pay-1" and stem("v2s") == "v2s"


def test_query_tokens():
    assert query_tokens("Refund the -well- FR-PAY-1 a", stemmed=False) == ["refund", "the", "well", "fr-pay-1"]


@pytest.mark.parametrize("base, target, out", [("a/b", "../c.md", "a/c.md"), ("a", "/x/./y", "x/y"), ("", "../../z", "z"), ("a", "b//c/", "a/b/c")])
def test_normalise(spark, base, target, out):
    from pyspark.sql import functions as F

    assert paths.normalise(base, target) == out
    whole = target if target.startswith("/") else f"{base}/{target}"
    assert spark.range(1).select(paths.normalise_column(F.lit(whole))).first()[0] == out


def test_scratch_is_written_and_cleared(spark):
    from quillgraph.shared import _own, clear, written

    df = written(spark.range(3), "numbers")
    assert df.count() == 3
    clear(spark)
    import os

    assert not os.path.exists(_own(spark).removeprefix("file://"))


def test_ids_in_one_scan():
    from quillgraph.functions.ids import find_ids

    ids = lambda t: [i for i, _ in find_ids(t)]
    assert ids("R-1601…R-1603 and INV-011/2/3") == ["R-1601", "R-1602", "R-1603", "INV-011", "INV-2", "INV-3"]
    assert ids("R-1601…R-1700") == ["R-1601", "R-1700"] and ids("R-1703…R-1601") == ["R-1703", "R-1601"]
    assert ids("FR-A-1…FR-B-3") == ["FR-A-1", "FR-A-2", "FR-A-3"]
    assert ids("R-1…R-2/3") == ["R-1", "R-2", "R-2", "R-3"]
    assert ids("XFR-PAY-22Y B1, BE-M02 T25 R-1…R-2X") == ["BE-M02", "R-1"]


def test_stream_holds_what_it_puts_off(spark, tmp_path):
    from quillgraph.streaming import refresh

    schema, seen = "rel string", []
    for run, want in ((0, []), (1, ["a", "b"])):
        spark.createDataFrame([("ab"[run],)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        step = lambda df, epoch: seen.extend(sorted(r["rel"] for r in df.collect()))
        refresh.watch_stream(stream, step, batch=2, checkpoint=f"{tmp_path}/state", once=True).awaitTermination()
        assert seen == want

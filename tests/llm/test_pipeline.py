"""The pipeline and its stages against plain rules on planted documents."""

import random

import corpus_pipeline
import pytest
from __spark_entry__ import queries as all_queries

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
INSULTS = ["wretch", "vermin", "dunce", "filthy"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in ("th", "on", "re", "in") for b in ("tion", "ed", "ly", "st") for c in ("a", "er", "an", "ou", "i")]

    def words(n):
        return [draw.choice(vocabulary) for _ in range(n)]

    passage, rows, labels = words(70), [], []
    for i in range(400):
        text = words(draw.randint(60, 200))
        if i % 5 == 0:
            for _ in range(4):
                text[draw.randrange(len(text))] = draw.choice(INSULTS)
            labels.append((i, 1))
        elif i % 2:
            labels.append((i, 0))
        if i in (11, 12, 13):
            text[30:30] = passage
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, rows[21][1]) for i in range(5)]
    near = rows[22][1].split()
    near[40] = "changed"
    rows += [(2000, " ".join(near)), (2001, ""), (2002, None), (2001, ""), (None, "a row that has no id at all")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(rows), passage


def test_stages(spark, folder):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), COLUMNS)
        kept.append({r["doc_id"]: r for r in docs.collect()})
    toxic = {i for i in range(400) if i % 5 == 0}
    assert not toxic & kept[0].keys() and kept[0].keys() >= set(range(400)) - toxic | {2001, 2002, None}
    assert not {1000, 1001, 1004, 2000, 2002} & kept[1].keys()
    assert kept[1].keys() == set(range(400)) - toxic | {2001, None}
    after = {i: (r["text"] or "").split() for i, r in kept[2].items()}
    assert kept[2].keys() == kept[1].keys()
    line = " ".join(passage)
    assert line in " ".join(after[11]) and line not in " ".join(after[12]) and line not in " ".join(after[13])
    # A neighbour of the passage may be the same word by chance.
    assert 66 <= len(texts[12].split()) - 4 - len(after[12]) <= 70
    assert kept[2][11]["text"] == texts[11]
    assert all(r["n_chars"] == len(r["text"]) for r in kept[2].values() if r["text"] is not None)


def test_stages_with_clashing_names_and_rows_without_id(spark, folder):
    """Columns that the stages might use themselves; copies among rows without id, and of them with others."""
    path, texts, passage = folder
    clashing = ["_row", "fp", "_fp", "_doc", "_digest", "_marks", "id", "words", "whole", "place", "own", "rest", "places", "digest", "component_id"]
    line = " ".join(passage)
    rows = [(i, texts[i]) for i in (21, 22, 11, 12)] + [(None, texts[21]), (None, texts[23]), (None, texts[23] + " more"), (None, line + " alone")]
    kinds = "doc_id bigint, text string, n_chars bigint, " + ", ".join(f"{c} string" for c in clashing)
    docs = spark.createDataFrame([(i, t, len(t), *[f"{c}{k}" for c in clashing]) for k, (i, t) in enumerate(rows)], kinds)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "n_chars", *clashing], name
        held = docs.collect()
        assert all(len({r[c].removeprefix(c) for c in clashing}) == 1 for r in held), name  # a row keeps its values together
        docs = spark.createDataFrame(held, docs.schema)
        if name == "simhash_near_dedup":
            nameless = [r["text"] for r in held if r["doc_id"] is None]
            assert {r["doc_id"] for r in held} == {21, 22, 11, 12, None} and len(nameless) == 2 and texts[21] not in nameless
    left = [r["text"] for r in held if r["doc_id"] is None and r["text"].endswith("alone")]
    assert len(left) == 1 and line not in left[0]


def test_run(spark, folder):
    rows = all_queries()["pipeline"](spark, folder[0]).collect()
    ids = {r["doc_id"] for r in rows}
    assert ids == {i for i in range(400) if i % 5} | {2001, None}
    assert max(r["offset"] + r["length"] for r in rows) <= 1024


def test_empty(spark, folder, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

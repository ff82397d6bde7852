"""Registered queries against their SQL, and the pipeline against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaitworks.llm import language, queries
from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    found = queries.QUERIES[name](spark, DATA).toArrow()
    assert compare(found, tables.execute(queries.ORACLES[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_covers_its_table(spark, tables, name):
    found = queries.QUERIES[name](spark, DATA)
    table = "pages" if "html" in name else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    # every query without SQL is about one of these two tables
    wanted = tables.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    assert found.select(key).distinct().count() == wanted


def test_every_operator_has_one_query():
    numbers = Counter(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == {n: 1 for n in range(1, 14)}


def shingles(words):
    folded = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    return {tuple(folded[i : i + 5]) for i in range(len(folded) - 4)} if len(folded) >= 5 else ({tuple(folded)} if folded else set())


def test_pipeline_against_plain_python(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(100_000, None, "en", "x", 0), (100_001, "12 !", "en", None, 4), (100_002, "", None, "x", 0), (None, docs.first()["text"], "en", "x", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    model = language.fit(docs)
    sure = {}
    for r in docs.collect():
        lang, score = model.predict(r["text"])
        if lang != "und" and score >= corpus_pipeline.LEAST_SCORE:
            sure.setdefault(r["doc_id"], r)
    assert 100_000 not in sure and 100_001 not in sure and 100_002 not in sure
    ids = sorted(sure, key=lambda i: (i is None, i or 0))
    sets = {i: shingles(sure[i]["text"].encode().split()) for i in ids}
    holders = defaultdict(list)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for place, i in enumerate(ids):
        common = Counter(j for s in sets[i] for j in holders[s])
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                first, last = (a, b) if ids.index(a) < ids.index(b) else (b, a)
                up[last] = first
        for s in sets[i]:
            holders[s].append(i)
    kept = {i: sure[i]["text"].encode().split() for i in ids if top(i) == i}
    seen = Counter(tuple(w[i : i + 35]) for w in kept.values() for i in range(len(w) - 34))
    final = {}
    for doc, w in kept.items():
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        # white space stays; a removed stretch goes from its first word to the end of its last
        text, places = sure[doc]["text"], [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", sure[doc]["text"])]
        assert len(places) == len(w)
        cut = set()
        for i in gone:
            cut.update(range(places[i][0], places[i + 1][0] if i + 1 in gone else places[i][1]))
        final[doc] = "".join(c for at, c in enumerate(text) if at not in cut)

    stages = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, DATA)
        assert stages.columns == docs.columns, name
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages.collect()}
    assert got == {doc: (text, len(text)) for doc, text in final.items()}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces = defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, stages, DATA).collect():
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    assert {doc: [x for _, part in sorted(parts) for x in part] for doc, parts in pieces.items()} == {
        doc: tokenizer.encode(text, add_special_tokens=False).ids + [1] for doc, text in final.items()
    }


def test_the_pipeline_runs_over_the_given_tables(spark):
    found = corpus_pipeline.run(spark, DATA)
    assert found.columns == ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    assert found.count() > 0


def test_the_substring_stage_keeps_white_space(spark):
    shared = " ".join(f"s{i}" for i in range(20)) + "\n\n\t" + "  ".join(f"s{i}" for i in range(20, 40))
    texts = ["  clean text\n\n    indented,  twice  spaced\r\nÄ end\n", f"\tfirst\n {shared}\n\nlast  word ", f"{shared} \n tail", "", None]
    docs = spark.createDataFrame([(i, "h", "en", x, 0) for i, x in enumerate(texts)], "doc_id long, url string, lang string, text string, n_chars long")
    found = corpus_pipeline.substring_dedup(spark, docs, DATA)
    assert found.columns == docs.columns
    expected = [texts[0], "\tfirst\n \n\nlast  word ", " \n tail", "", None]
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in found.collect()} == {i: (x, len(x or "")) for i, x in enumerate(expected)}


def test_the_near_dedup_stage_takes_copies_from_80_per_cent(spark):
    words = [[f"w{group}x{i}" for i in range(200)] for group in range(3)]
    rows = []
    for group, changes in enumerate([4, 5, 1]):
        copy = [w if (i + 20) % 40 or i // 40 >= changes else "changed" for i, w in enumerate(words[group])]
        rows += [(2 * group, " ".join(words[group])), (2 * group + 1, " ".join(copy))]
    docs = spark.createDataFrame([(i, "h", "en", x, len(x)) for i, x in rows], "doc_id long, url string, lang string, text string, n_chars long")
    sets = [shingles(x.encode().split()) for _, x in rows]
    similar = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert 0.8 < similar[0] < 0.85 and similar[1] < 0.8 and similar[2] > 0.85
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()) == [0, 2, 3, 4]


EMPTY = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
    "labels": "doc_id long, quality int, toxic int",
}


@pytest.fixture(scope="module")
def no_rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in EMPTY.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [*sorted(queries.QUERIES), "pipeline"])
def test_empty_tables_give_no_rows(spark, no_rows, name):
    build = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    assert build(spark, no_rows).collect() == []


def test_the_stages_keep_columns_of_any_name(spark):
    """Columns that clash with names inside the operators, repeated rows, null and very long texts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "x", 0), (9003, "the same words and more of them. " * 40_000, "en", "x", 1)], docs.schema)
    docs = docs.unionByName(docs.limit(20)).unionByName(odd)
    names = ["kept", "n_words", "n_shingles", "score", "k1", "span", "group", "place", "ids", "_text", "_score"]
    docs = docs.select("*", *[F.lit(i).alias(name) for i, name in enumerate(names)])
    stages = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, DATA)
        assert stages.columns == docs.columns, name
    rows = stages.collect()
    assert len(rows) > 10 and len({r["doc_id"] for r in rows}) == len(rows)
    assert all([r[name] for name in names] == list(range(len(names))) for r in rows)
    assert not {9001, 9002} & {r["doc_id"] for r in rows}
    pieces = corpus_pipeline.STAGES[-1][1](spark, stages, DATA)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in rows}

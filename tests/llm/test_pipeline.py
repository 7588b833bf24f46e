import hashlib
import os
import re
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from polysem.llm import queries, sql
from tests.llm.conftest import prose
from tests.llm.test_decontaminate import distance, fold
from tests.llm.test_minhash import plain_shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, frame, tmp_path_factory):
    """Documents with copies, near copies, passages and junk; a folder with the benchmark."""
    passages = [(1, prose("en", 30, 501)), (2, prose("de", 25, 502)), (3, None)]
    rows = [(i, prose(("en", "de", "fr")[i % 3], 80, i), ("en", "de", "fr")[i % 3]) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "\n", 3), "en") for i in range(10)]  # equal but for white space
    rows += [(200 + i, rows[i + 20][1] + " more words here", "de") for i in range(10)]  # near copies
    rows += [(300, prose("en", 40, 7) + " " + passages[0][1].upper() + " " + prose("en", 40, 8), "en")]
    rows += [(301, "x " + passages[1][1].replace("a", "e", 2), "de")]
    rows += [(400, None, "en"), (401, "", "en"), (402, "12 %% 34", None), (None, prose("fr", 50, 9), "fr"), (5, rows[5][1], "fr")]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(passages, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame(rows).write.parquet(f"{folder}/documents.parquet")
    return rows, passages, folder


def brute(rows, passages):
    """(id, text) of the documents that the first four stages keep."""
    kept = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t or "")]
    best = {}
    for i, t in kept:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if norm not in best or (i is not None and (best[norm][0] is None or i < best[norm][0])):
            best[norm] = (i, t)
    kept = sorted(best.values(), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [plain_shingles(t) for _, t in kept]
    label = list(range(len(kept)))
    for _ in range(len(kept)):
        for a in range(len(kept)):
            for b in range(a):
                if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    kept = [r for k, r in enumerate(kept) if label[k] == k]
    clean = []
    for i, t in kept:
        folded = [(fold(p), fold(t)) for _, p in passages if p]
        if not any(distance(p, x) <= int(0.09 * len(p)) for p, x in folded):
            clean.append((i, t))
    return clean


def test_run_against_brute_force(spark, planted):
    rows, passages, folder = planted
    want = brute(rows, passages)
    got = corpus_pipeline.run(spark, folder).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r["doc_id"], r["decoded_sha256"]) for r in got), key=str) == sorted(((i, digest(t)) for i, t in want), key=str)
    assert all(len(r["ids"]) == r["n_tokens"] > 0 for r in got)
    ids = {i for i, _ in want}
    assert not ids & {*range(100, 110), *range(200, 210), 300, 301, 400, 401, 402} and len(want) == 61


def test_stages_keep_columns_and_take_anything(spark, odd, nothing, planted):
    folder = planted[2]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (odd, nothing):
            out = stage(spark, docs, folder)
            assert out.count() <= docs.count()
            if k < 4:
                assert out.columns == docs.columns


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    found = con.execute(sql.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_return_their_columns(spark, name):
    need = {
        "op2": "doc_id class_id", "op3": "doc_id keep_id group_size kept text_sha256",
        "op4": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op5": "doc_id held_out score predicted",
        "op6": "doc_id held_out lang_pred score", "op7": "doc_id item_id", "op8": "page_id url text n_chars",
        "op9": "doc_id n_tokens ids_sha256 decoded_sha256", "op10": "doc_id size text_crc32 law shard slot grown_shard",
        "op11": "anchor_id positive_id rank negative_id positive_score negative_score",
        "op12": "doc_id n_words n_base first_word last_word base_labels labels score", "op13": "item_id rank doc_id score",
    }.get(name.split("_")[0], "")
    got = queries.queries()[name](spark, SF)
    assert set(need.split()) <= set(got.columns)
    rows = {"op1": None, "op7": None, "op8": 50, "op11": 150, "op13": 400}.get(name.split("_")[0], 200)
    assert rows is None or got.count() == rows


def test_the_other_queries_stand_without_the_subpackage(tmp_path):
    code = (
        "import sys; sys.modules['polysem.llm'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)

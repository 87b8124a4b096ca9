import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import queries, sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    """The contract's patterns as they are given, by another engine."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(sum(map(int, str(x * (1 + k % 2)))) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def found(spark, texts):
    rows = frame(spark, texts).select("doc_id", sanitise.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect()
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.s] for r in rows}


def test_base_spans_against_the_given_patterns(spark):
    rng = random.Random(5)
    parts = ["a@b.c", "x.y_z+1@d-e.f.g", "@", ".", "_", "é", " ", "-", "+", "1.2.3.4", "255", "256.1.1.1.7", "0007", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (403) 555-9312", "(", ")", "7", "\n", "😀", "%", "abc"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8.9", "+" * 50, "", None, "0" * 17 + " 4111111111111111", "a@b" + ".c" * 30_000, "9" * 5000, "a." * 5000 + "@b.c", "1.2.3.4 " * 3000 + "😀", "+1 " + "(" * 100_000]
    got = found(spark, texts)
    for k, t in enumerate(texts):
        assert got[k] == base(t or ""), t[:80]


def sql_rows(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.execute(queries.ORACLE_SQL["op12_pii"]).fetchall(), key=repr)


def test_query_against_sql(spark, small, tmp_path):
    rng = random.Random(2)
    common = [f"w{k}ord" for k in range(300)]
    talk = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(k, f"{talk(60)} {rng.choice([f'Knight{k % 5}', f'the laureate of 77{k % 3}', ''])} wrote to don{k % 5}@mancha.es or +34 600 000 00{k % 3}, {talk(40)}") for k in range(60)]
    rows += [(100, None), (101, ""), (None, talk(30)), (None, talk(30)), (102, "x@y.zz"), (102, "x@y.zz"), (103, "Sancho x@y.zz Sancho 10.0.0.1 Sancho"), (104, "sancho " * 40), *((200 + k, talk(100)) for k in range(60))]
    spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, pii_base string, row int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_pii(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5 + ["string"] * 2
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == sql_rows(rows)
    assert any("term:" in r[-1] for r in got) and all("term:" not in r[-1] for r in got if r[0] is not None and r[0] >= 200)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op12_pii(spark, small).collect()), key=repr) == sql_rows(docs)


def test_only_spark_expressions(spark, small):
    plan = queries.op12_pii(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_terms_disclose_only_where_the_entity_is_named(spark):
    filler = ["alpha beta gamma delta"] * 200
    docs = [(1, "Zorro is z@m.ex"), (2, "write z@m.ex, Zorro"), (3, "Zorro rides"), (4, "alpha z@m.ex"), *((10 + k, t) for k, t in enumerate(filler))]
    got = {r.doc_id: r for r in sanitise.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(t.start, t.end, t.instead) for t in got[1].pii_terms] == [(0, 5, "[WORD]")]
    assert [(t.start, t.end) for t in got[2].pii_terms] == [(14, 19)]
    assert got[3].pii_terms == [] and got[4].pii_terms == [] and got[4].pii_base[0].end == 12


def test_clean_texts(spark):
    docs = [(1, "Zorro is z@m.ex, 😀 +34 600 000 001"), (2, "write z@m.ex, Zorro"), (3, None), (4, "4111 1111 1111 1111, +12 10.0.0.1 0!"), *((k, "alpha beta") for k in range(10, 200))]
    df = spark.createDataFrame([(b, 7, a) for a, b in docs], "text string, __row int, doc_id long")
    out = sanitise.sanitise(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == "[WORD] is [EMAIL], 😀 [PHONE]" and got[2] == "write [EMAIL], [WORD]" and got[3] is None and got[10] == "alpha beta"
    assert got[4] == "[CARD], [PHONE]!" and sanitise.sanitise(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_long_folds(spark, n):
    text = "é1.1.1.1 " * n
    assert found(spark, [text])[0] == base(text)
    row = frame(spark, [text]).select(sanitise.base_spans(F.col("text")).alias("b"), "text")
    clean = row.select(sanitise.clean_text(F.col("text"), F.col("b"), F.array().cast("array<struct<start:bigint,end:bigint,instead:string>>")).alias("c"))
    assert clean.first().c == "é[IP] " * n


def test_digest_of_nothing(spark, small):
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in queries.op12_pii(spark, small).where("n_email + n_ip + n_card + n_phone = 0").collect()} == {empty}

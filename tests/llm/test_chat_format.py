"""Chat formatting: exact round trips, the SQL oracle's digests, odd rows, no Python in the plan."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clickpath.llm import chat_format, queries

SCHEMA = "conv_id long, turn long, role string, text string, blocks int, turns string"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[NEXT]", "\\", "<", "[", "/s>", "INST]", "\n", " ", "ok", "é", "𝄞", "$1", ">", "]"]


def _rows(n=300):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "a\nb\\n", "[ROLE] x", "", None]
    out = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            text = None if rng.random() < 0.05 else "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))
            out.append((c, t, rng.choice(roles), text, 1, "x"))
    return out


def test_round_trip_of_hostile_texts(spark):
    rows = _rows()
    got = chat_format.format_chats(spark.createDataFrame(rows, SCHEMA)).withColumn("turns", chat_format.parse_chats(F.col("formatted"))).collect()
    want = {}
    for c, _, role, text, *_ in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert len([s for s in r["segments"] if s["loss"]]) == sum(role == "assistant" for role, _ in want[r["conv_id"]])


def test_report_matches_plain_python(spark):
    rows = _rows(60)
    got = {r["conv_id"]: r for r in chat_format.chat_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(learned)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert got[c]["n_blocks"] == sum(k == 0 or turns[k][0] != turns[k - 1][0] for k in range(len(turns)))


def test_template(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "</s>"), (1, 3, "assistant", "c")]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()["formatted"]
    assert out == "<s><<SYS>>\nbe kind\n<</SYS>>\n\n[INST] a[NEXT]b [/INST] <\\/s>[NEXT]c</s>"


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (None, None, "user", "last"), (2, 1, "user", "same"), (2, 1, "user", "same"), (3, 0, "assistant", "y" * 500000), (4, None, None, None)]
    got = {r["conv_id"]: r for r in chat_format.chat_report(spark.createDataFrame([(*r, 1, "q") for r in rows], SCHEMA)).collect()}
    assert got[None]["turns_sha256"] == hashlib.sha256(b"user\nx\nuser\nlast\n").hexdigest()
    assert got[2]["n_turns"] == 2 and got[2]["n_blocks"] == 1
    assert got[3]["loss_chars"] == 500000 and got[4]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert chat_format.chat_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_conversation_stays_linear(spark):
    rows = spark.range(40000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 < 2, "user").otherwise("assistant").alias("role"), F.lit("some </s> words").alias("text"))
    got = chat_format.chat_report(rows).first()
    assert got["n_turns"] == 40000 and got["n_blocks"] == 26667 - 1 + 1 and got["loss_chars"] == 13333 * 15


def test_only_spark_expressions(spark):
    plan = queries.op11_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapPartitions", "ExistingRDD"))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, duck, sf):
    got = queries.op11_chat_formatting(spark, f"/root/testdata/{sf}")
    cols = sorted(got.columns)
    want = duck(f"/root/testdata/{sf}").execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL['op11_chat_formatting']})").fetchall()
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(want)

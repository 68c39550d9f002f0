import random

from pyspark.sql import functions as F

from sextant.llm import chat
from sextant.llm.chat import chats
from sextant.llm.queries import ORACLE, QUERIES
from tests.oracle import assert_same

SCHEMA = "conv_id long, turn long, role string, text string"


def test_sql(spark, sf_dir):
    assert_same(spark, QUERIES["op2_chat_format"], ORACLE["op2_chat_format"], sf_dir)


def test_against_string_building(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 2, 3, None]), r.choice([0, 1, 2, None]), r.choice(["user", "assistant", None, "système"]), r.choice(["", None, "ein Text", "日本語 🙂", "x" * 70_000])) for _ in range(60)]
    want = {}
    null_first = lambda v: (v is not None, v if v is not None else 0)
    for c, t, role, text in sorted(rows, key=lambda x: (null_first(x[1]), (x[2] is not None, x[2] or ""), (x[3] is not None, (x[3] or "").encode()))):
        want[c] = want.get(c, "") + f"<|im_start|>{role or 'unknown'}\n{text or ''}<|im_end|>\n"
    got = chats(spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2))).collect()
    assert {x.conv_id: x.formatted for x in got} == want
    assert all(x.n_bytes == len(x.formatted.encode()) for x in got)
    spoken = {c: sum(len((t or "").encode()) for k, _, role, t in rows if k == c and role == "assistant") for c in want}
    assert {x.conv_id: x.assistant_bytes for x in got} == spoken


def test_empty(spark):
    assert chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_batches_are_cut_by_their_bytes(monkeypatch):
    import pyarrow as pa

    r = random.Random(4)
    turns = [[{"turn": t, "role": r.choice(["user", None, "assistant"]), "text": r.choice([None, "", "a" * r.randint(0, 500)])} for t in range(r.randint(0, 6))] for _ in range(80)]
    kind = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(80), pa.int64()), pa.array(turns, kind)], ["conv_id", "turns"]).slice(7, 60)
    whole = pa.Table.from_batches(list(chat._format([batch])))
    monkeypatch.setattr(chat, "BATCH_BYTES", 700)
    parts = list(chat._format([batch]))
    assert len(parts) > 10 and pa.Table.from_batches(parts).to_pydict() == whole.to_pydict()
    assert whole["formatted"].to_pylist() == ["".join(f"<|im_start|>{t['role'] or 'unknown'}\n{t['text'] or ''}<|im_end|>\n" for t in c) for c in turns[7:67]]

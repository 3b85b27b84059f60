"""Streams of pieces: split tags, late and repeated pieces, state that ends."""

import random

import pandas as pd
import pytest

from quarry.streaming import pieces as P

SCHEMA = "query_id long, seq long, piece string, last boolean"


def cut(text, r):
    at = sorted(r.sample(range(1, len(text)), min(len(text) - 1, r.randint(1, 9)))) if len(text) > 1 else []
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


def streams(seed=4):
    r = random.Random(seed)
    parts = ["<think>", "</think>", "<THINK a=1>", "a < b", "x", "<", "thin", "\n", "<b>", "long text without a tag "]
    out = []
    for i in range(30):
        pieces = cut("".join(r.choices(parts, k=r.randint(1, 8))), r)
        out += [(i, n, p if r.random() < 0.95 else p, n == len(pieces) - 1) for n, p in enumerate(pieces)]
    return out + [(77, 0, None, False), (77, 1, "ok", True), (78, 0, "never ", False), (78, 2, "shown", True)]


def write(spark, path, rows, batches, seed):
    r = random.Random(seed)
    dealt = [[] for _ in range(batches)]
    for row in rows:
        dealt[r.randrange(batches)].append(row)
    for i, part in enumerate(dealt):
        spark.createDataFrame(part or rows[:1], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{i}")


def test_late_and_repeated_pieces(spark, tmp_path):
    rows = streams()
    write(spark, f"{tmp_path}/in", rows, 4, 1)
    write(spark, f"{tmp_path}/in", rows[::3], 2, 2)  # again
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    shown, progress = P.shown_texts(stream, f"{tmp_path}/out")
    whole = {r.query_id: r.text for r in P.filter_pieces(spark.createDataFrame(rows, SCHEMA)).collect() if r.query_id != 78}
    assert {r.query_id: r.text for r in shown.collect()} == {k: v for k, v in whole.items() if v} | {78: "never "}
    assert len([p for p in progress if p["numInputRows"]]) >= 4


def test_state_is_empty_when_all_streams_have_ended(spark, tmp_path):
    rows = [r for r in streams() if r[0] != 78]
    write(spark, f"{tmp_path}/in", rows, 3, 5)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    _, progress = P.shown_texts(stream, f"{tmp_path}/out")
    left = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert left[-1] == 0 and max(left) > 0


def test_stream_that_comes_again_after_its_end_is_shown_once(spark, tmp_path):
    rows = [(1, 0, "a <", False), (1, 1, "b <thi", False), (1, 2, "nk>c</think>d <", True), (2, 0, "whole", True)]
    again = [rows[:1], rows[1:], [rows[0], rows[3]], rows]  # other cuts of the same streams
    for i, part in enumerate([rows, *again]):
        write(spark, f"{tmp_path}/in/{i}", part, 1, 1)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*/*")
    shown, _ = P.shown_texts(stream, f"{tmp_path}/out")
    assert sorted((r.query_id, r.text) for r in shown.collect()) == [(1, "a <b d <"), (2, "whole")]


class Handle:
    """State in dictionaries, which counts the calls."""

    def __init__(self):
        self.calls, self.states = 0, []

    def getMapState(self, *_):
        self.states.append(State(self))
        return self.states[-1]

    getValueState = getMapState


class State:
    def __init__(self, handle):
        self.handle, self.rows = handle, {}

    def __getattr__(self, name):
        def call(key=(), value=None):
            self.handle.calls += 1
            if name == "update":
                key, value = (), key
            if name in ("updateValue", "update"):
                self.rows[key] = value
            elif name == "clear":
                self.rows.clear()
            elif name == "removeKey":
                self.rows.pop(key, None)
            return key in self.rows if name in ("containsKey", "exists") else self.rows.get(key)

        return call


def in_batches(rows, n, seed):
    r = random.Random(seed)
    dealt = [[] for _ in range(n)]
    for row in rows:
        dealt[r.randrange(n)].append(row)
    return [pd.DataFrame(part, columns=["query_id", "seq", "piece", "last"]) for part in dealt if part]


def test_state_is_read_once_a_stream_and_batch():
    processor, handle = P._Reordered(None), Handle()
    processor.init(handle)
    rows = [(9, i, "piece %d" % i, i == 199) for i in range(200)]
    shown = [x for batch in in_batches(rows, 4, 3) for x in processor.handleInputRows((9,), iter([batch]), None)]
    assert "".join(pd.concat(shown)["text"]) == "".join(r[2] for r in rows)
    assert handle.calls <= 4 * 4


@pytest.mark.parametrize("block", [1, 3, 256])
def test_blocks_of_waiting_pieces(monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rows = [(r[0], r[1], r[2] or "", r[3]) for r in streams(block) if r[0] < 30] + [(50, i, f"<think>{i}</think>{i} < ", i == 40) for i in range(41)]
    whole = {}
    for i in sorted({r[0] for r in rows}):
        f = P.ReasoningFilter()
        whole[i] = "".join(f.feed(r[2]) for r in sorted(rows) if r[0] == i) + f.finish()
    for seed in range(5):
        processor, handle = P._Reordered(None), Handle()
        processor.init(handle)
        shown = {}
        for batch in in_batches(rows + rows[::5], 6, seed):
            for x in processor.handleInputRows((0,), iter([batch[:7], batch[7:]]), None):
                shown |= {(q, n): text for q, n, text in x.itertuples(index=False)}
        assert {i: "".join(text for (q, _), text in sorted(shown.items()) if q == i) for i in whole} == whole
        ended = {r[0] for r in rows} - {q for (q,) in handle.states[0].rows}  # a piece that comes again after the end opens a state
        assert {q for q, _ in handle.states[1].rows}.isdisjoint(ended)

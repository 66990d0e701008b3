import hashlib

import duckdb
import numpy as np
import pytest

from websift.llm import chat, oracles

SCHEMA = "conv_id long, turn int, role string, text string, part long, formatted string, _tie string"
NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> [\\INST]", "<|endoftext|><\\|endoftext|>", "[INST", "INST]", "<", "[", "", "  \n ", "日本語 é́ 🙂",
         "\\", "]", "/s>", "[[INST]]", "a" * 5000, " " * 5000 + "\n" * 5000]


def table():
    rows = [(c, t, ["user", "assistant"][t % 2], f"{NASTY[(c + t) % len(NASTY)]} {c}" if t % 3 else NASTY[(c * 3 + t) % len(NASTY)])
            for c in range(40) for t in range(c % 5 + 1)]
    rows += [(100, t, "assistant", NASTY[t % len(NASTY)]) for t in range(60)]
    rows += [(50, None, "system", "first"), (50, 0, None, None), (50, 1, "assistant", None), (50, 2, "assistant</s>", "x"), (51, 0, "assistant", "<"),
             (51, 1, "assistant", "/s>"), (None, 0, "user", "no id"), (52, 1, "user", "same"), (52, 1, "user", "same"), (52, 1, "assistant", "same")]
    return [(*r, 1, "x", "y") for r in rows]


def brute(rows):
    out = {}
    rows = [*rows, (-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])]
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return {c: (len(x), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in x).encode()).hexdigest(),
                sum(len(t) for r, t in x if r == "assistant"),
                hashlib.sha256("".join(t for r, t in x if r == "assistant").encode()).hexdigest()) for c, x in out.items()}


@pytest.fixture(scope="module")
def form():
    return chat.Format()


@pytest.mark.parametrize("text", NASTY)
def test_escape_is_reversible_and_leaves_no_control_string(form, text):
    for _ in range(3):
        e = form.escape(text)
        assert form.unescape(e) == text and not any(s in e for s in ("[INST]", "[/INST]", "</s>", "<|endoftext|>"))
        text = e


def test_mask_equals_comparing_every_token_with_every_span():
    rng = np.random.default_rng(3)
    for _ in range(200):
        edges = np.sort(rng.choice(60, 2 * int(rng.integers(0, 6)), replace=False))
        spans = [tuple(map(int, s)) for s in edges.reshape(-1, 2)]
        starts = np.sort(rng.integers(0, 60, 20))
        offsets = np.stack([starts, starts + rng.integers(0, 4, 20)], axis=1)
        want = [any(a < e and b > s for s, e in spans) and b > a for a, b in offsets]
        got = chat.mask(offsets, spans) & (offsets[:, 1] > offsets[:, 0])
        assert got.tolist() == want


@pytest.mark.parametrize("part_chars", [chat.PART_CHARS, 40])
def test_round_trip_equals_brute_force(spark, part_chars):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    parts = chat.format_chat(df.select("conv_id", "turn", "role", "text").unionByName(chat.probe(df).withColumn("turn", chat.F.col("turn").cast("int"))),
                             part_chars=part_chars)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(parts).collect()}
    assert got == brute([r[:4] for r in rows])
    if part_chars == chat.PART_CHARS:
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(df).collect()} == got


def test_parts_have_the_ids_of_the_whole(spark, form):
    df = spark.createDataFrame(table(), SCHEMA)
    small = chat.format_chat(df, part_chars=30).orderBy("conv_id", "part").collect()
    whole = {}
    for r in small:
        s, i, m = whole.get(r.conv_id, ("", [], b""))
        whole[r.conv_id] = (s + r.formatted, i + r.input_ids, m + bytes(r.loss_mask))
    assert len(small) > 2 * len(whole)
    for s, i, m in whole.values():
        assert form.tokenizer.encode(s, add_special_tokens=False).ids == i and len(i) == len(m)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.format_chat(empty).count() == 0 and [r.conv_id for r in chat.digests(empty).collect()] == [-7]


def test_sql_agrees(spark):
    rows = [r[:4] for r in table() if r[0] is not None and r[0] != 52]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"turn": "Int64"}))
    want = con.sql(oracles.CHAT).df().sort_values("conv_id").values.tolist()
    got = chat.digests(df).toPandas()[["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]].sort_values("conv_id").values.tolist()
    assert got == want

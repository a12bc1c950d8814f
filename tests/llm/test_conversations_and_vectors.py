"""Chat formatting, conversation repair and whitening against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import chat_format, conversation_repair, whitening

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


# chat formatting


def test_chat_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(chat_format.ORACLE_SQL)
    got = chat_format.op12_chat_format(spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.df()[names].astype(object).itertuples(index=False)))


def test_all_layouts_become_the_same_turns(spark):
    hello, there = {"role": "user", "text": "hello"}, {"role": "assistant", "text": "there"}
    system = {"role": "system", "text": "be kind"}
    cases = [
        ({"prompt": "hello", "response": "there"}, "prompt", [hello, there]),
        ({"response": "there", "system": "be kind", "prompt": "hello"}, "prompt", [system, hello, there]),
        ({"prompt": None, "response": "there"}, "prompt", [{"role": "user", "text": ""}, there]),
        ({"instruction": "hello", "output": "there"}, "instruction", [hello, there]),
        ({"instruction": "hello", "input": "you", "output": "there"}, "instruction", [{"role": "user", "text": "hello\n\nyou"}, there]),
        ({"messages": [{"role": "user", "content": "hello"}, {"content": "there", "role": "assistant"}]}, "messages", [hello, there]),
        ({"messages": [{"role": None, "content": None}, {"content": "there", "role": "tool"}]}, "messages", [{"role": "", "text": ""}, {"role": "tool", "text": "there"}]),
        ({"messages": []}, "messages", []),
        ({"conversations": [{"from": "system", "value": "be kind"}, {"from": "human", "value": "hello"}, {"from": "gpt", "value": "there"}]}, "from_value", [system, hello, there]),
        ({"prompt": "hello"}, None, None),
        ({"question": "hello", "answer": 3}, None, None),
    ]
    rows = [(i, json.dumps(c[0])) for i, c in enumerate(cases)] + [(100, None), (101, "no { json"), (0, json.dumps(cases[0][0])), (None, json.dumps(cases[3][0]))]
    df = spark.createDataFrame(rows, "conv_id long, record string").withColumns({"v": F.lit(1), "turns": F.lit(2), "paths": F.lit(3)})
    found = [(r.conv_id, r.layout, None if r.turns is None else [t.asDict() for t in r.turns]) for r in chat_format.canonical_turns(df).collect()]
    for i, (_, layout, turns) in enumerate(cases):
        own = [f[1:] for f in found if f[0] == i]
        assert own == [(layout, turns)] * (2 if i == 0 else 1)
    assert [f[1:] for f in found if f[0] in (100, 101)] == [(None, None)] * 2
    assert [f[1:] for f in found if f[0] is None] == [("instruction", [hello, there])]
    other = [chat_format.Layout("question", '{"question": "", "answer": ""}', turns=(("user", ("question",)), ("assistant", ("answer",))))]
    assert [r.turns[1].text for r in chat_format.canonical_turns(df, other).where("layout = 'question'").collect()] == ["3"]


def odd_texts(rng, n):
    pieces = [*chat_format.CONTROLS, "\\", "<", "[", ">", "]", "\\<", "<\\", "s>", "INST]", "/", "é", "🙂", "\n", "$1", "a"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(n)]


def test_formatted_texts_come_back(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        roles = [rng.choice(["user", "assistant", "system", "tool", "", "<s>", "a\nb", "x<<TEXT>>\\", "<"]) for _ in range(rng.randrange(8))]
        rows.append((i, [{"role": r, "text": t} for r, t in zip(roles, odd_texts(rng, len(roles)), strict=True)]))
    rows += [(500, None), (501, [])]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<role: string, text: string>>").withColumn("part", F.lit("x"))
    out = chat_format.format_turns(df, turns_per_part=3)
    read = out.select("conv_id", "part", "formatted", "loss", chat_format.parse_turns(F.col("formatted")).alias("turns"), chat_format.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).orderBy("conv_id", "part").collect()
    for conv_id, turns in rows:
        own = [r for r in read if r.conv_id == conv_id]
        assert [t.asDict() for r in own for t in r.turns] == (turns or [])
        assert "".join(r.learned for r in own) == "".join(t["text"] for t in turns or [] if t["role"] == "assistant")
        assert len(own) == max(1, -(-len(turns or []) // 3))
        for r in own:  # no text opens or closes a turn
            inside = re.sub("|".join(map(re.escape, chat_format.CONTROLS)), "", r.formatted)
            assert all(c not in s for s in [r.formatted[x.start : x.start + x.length] for x in r.loss] for c in chat_format.CONTROLS) and inside is not None


def test_rows_of_odd_conversations(spark, tmp_path):
    rows = [(1, 1, "assistant", None), (1, 0, None, "q"), (2, None, "user", "x"), (2, None, "user", "x"), (None, 0, "user", "n"), (3, 5, "assistant", "é" * 70_000)]
    df = spark.createDataFrame(rows, TURNS).withColumns({"part": F.lit(1), "record": F.lit("r")})
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.op12_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {k: v.n_turns for k, v in got.items()} == {1: 2, 2: 2, None: 1, 3: 1, -7: 2}
    assert got[1].turns_sha256 == sha("\nq\nassistant\n\n") and got[1].loss_chars == 0
    assert got[3].loss_sha256 == sha("é" * 70_000) and got[3].loss_chars == 70_000
    assert got[-7].loss_sha256 == sha(chat_format.PLANTED)
    empty = tmp_path / "empty"
    spark.createDataFrame([], TURNS).write.parquet(f"{empty}/conversations.parquet")
    assert [r.conv_id for r in chat_format.op12_chat_format(spark, str(empty)).collect()] == [-7]


# conversation repair


def brute_repair(rows):
    """Every sequence of edits by length, over rows ``(role, text, damaged, truncated)``."""
    best = None
    n = len(rows)

    def walk(k, audit, cost, out, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        initials = "".join(r[:1] or "?" for r, _ in out)  # a role without initial fits nowhere
        if initials and not re.fullmatch("s?(ua)*u?", initials):
            return
        if k == n and re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, list(out))
        if inserted < 3:
            for role in ("user", "assistant"):
                walk(k, audit + "I", cost + 3, [*out, (role, "")], inserted + 1)
        if k == n:
            return
        role, text, gone, cut = rows[k]
        walk(k + 1, audit + "D", cost + 4, out, 0)
        if not gone:
            walk(k + 1, audit + "K", cost + 3 * cut, [*out, (role, text)], 0)
            for other in ("user", "assistant"):
                walk(k + 1, audit + "R", cost + 3 + 3 * cut, [*out, (other, text)], 0)

    walk(0, "", 0, [], 0)
    return best


def test_repair_is_the_cheapest_and_least(spark):
    rng = random.Random(9)
    for _ in range(400):
        rows = []
        for i in range(rng.randrange(7)):
            gone = rng.random() < 0.2
            rows.append((rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", " "]), f"t{i}", gone, not gone and rng.random() < 0.3))
        repair = conversation_repair.Repair()
        for r in rows:
            repair.add(*r)
        cost, audit, out = brute_repair(rows)
        assert (repair.finish(), "".join(repair.audit)) == (cost, audit), rows
        assert repair.digest.hexdigest() == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_long_conversations_are_put_out_while_they_pass():
    rng = random.Random(2)
    repair = conversation_repair.Repair()
    for i in range(30_000):
        repair.add(rng.choice(["user", "assistant"]), f"t{i}.", rng.random() < 0.1, rng.random() < 0.1)
    assert repair.most < 300 and len(repair.rows) < 300
    repair.finish()
    assert len(repair.audit) - repair.audit.count("I") == 30_000


def brute_report(rows):
    """The contract, row by row, for ``rows`` of one table."""
    found = {}
    for conv_id, turn, role, text in rows:
        own = found.setdefault(conv_id, [])
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv_id, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, rows_ = set(), [], []
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            rows_.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, kept = brute_repair(rows_)
        out[conv_id] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def test_repair_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.op13_conversation_repair(spark, SF).collect()}
    assert got == brute_report(rows)


def test_repair_of_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    texts = ["one.", "two", "", " \n", None, "one.", "é!", "end . \t", "x" * 200_000]
    rows = [(rng.choice([1, 2, 3, 4, 5, 6, None]), rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(["user", "assistant", "system", None, "", "User"]), rng.choice(texts)) for _ in range(40)]
    rows = [r for r in rows if r[0] != 6] + [(6, 12, "user", "all gone?"), (6, 12, "user", "all gone?")]
    drop = next(i for i in range(1000) if zlib.crc32(f"6:{i}".encode()) % 20 == 0)
    rows = [(c, drop if c == 6 else t, r, x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, TURNS).repartition(3).withColumns({"gone_": F.lit(1), "kind": F.lit(2), "repeated": F.lit(3), "label": F.lit("x")})
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == brute_report(rows)
    assert got[6] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = tmp_path / "empty"
    spark.createDataFrame([], TURNS).write.parquet(f"{empty}/conversations.parquet")
    assert conversation_repair.op13_conversation_repair(spark, str(empty)).count() == 0


# whitening


def brute_whitening(rows, most=16):
    kept = [(i, np.floor(np.asarray(e, np.float64) * 64).astype(int) + 1_000_000) for i, e in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    c = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return kept, n, sums, values, vectors, np.trace(c.T @ c / n)


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_whitening_matches_a_full_decomposition(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    kept, n, sums, values, vectors, trace = brute_whitening(rows)
    got = whitening.op11_embedding_whitening(spark, folder).toPandas()
    assert len(got) == 16 * len(kept) and (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in kept]].to_numpy()
    want = (np.array([x for _, x in kept]) - np.array(sums) / n) @ vectors / np.sqrt(values)
    sign = np.sign((table * want).sum(0))
    assert np.abs(table * sign - want).max() < 1e-6
    assert np.allclose(got.groupby("component")["explained"].first(), values / trace, rtol=1e-9)
    deviation = got.groupby("vec_id")["deviation"].first()
    assert all(deviation[i] == sum((n * int(c) - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in kept)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    rows += [(0, rows[5][1]), (None, rows[6][1]), (90, None), (91, [1.0, None, 2.0, 3.0]), (92, [1.0, float("nan"), 0.0, 0.0]), (93, [float("inf")] * 4), (94, [1.0, 2.0]), (95, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({"x": F.lit(1), "n": F.lit(2), "component": F.lit(3)})
    got = whitening.whiten(df).collect()
    assert len(got) == 32 * 4 and {r.n for r in got} == {30} and max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(df, 2).count() == 32 * 2
    # a direction without variance has no component; huge entries have no deviation in a long
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.deviation is None) for r in whitening.whiten(huge).collect()} == {(1, True), (2, True), (3, False)}
    for none in (df.limit(0), flat.limit(1), flat.where("vec_id = 2").unionAll(flat.where("vec_id = 2"))):
        assert whitening.whiten(none).count() == 0


def test_counts_of_pivots_are_those_of_eigenvalues():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = rng.integers(-3, 4, size=(d := int(rng.integers(1, 12)), d)).astype(float)
        values = np.linalg.eigvalsh(a + a.T)
        assert whitening.inertia(a + a.T)[:2] == ((values > 1e-9).sum(), (values < -1e-9).sum())
    for spectrum in ([3, 3, 3, 2, 2, 1, 0, 0], [1] * 20, [1e6, 1, 1, 1e-3], [5.0, 5.0 - 1e-12, 1]):
        q, _ = np.linalg.qr(rng.normal(size=(len(spectrum), len(spectrum))))
        values, vectors = whitening.leading_eigenpairs(q * spectrum @ q.T)
        want = [s for s in sorted(spectrum, reverse=True) if s > 0][:16]
        assert np.allclose(values, want, rtol=1e-9) and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs((q * spectrum @ q.T) @ vectors - vectors * values).max() < 1e-9 * max(spectrum)

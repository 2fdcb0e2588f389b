"""Fill-in-middle against a plain cut, conversation repair against all edit sequences."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evirank.llm import fim, repair

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow_fim(doc_id, text):
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def fim_rows():
    rnd = random.Random(3)
    alphabet = ["a", "bé", "日本", "😀", " ", "\t\n", "  ", "\x0b", " ", "<", "P>", "S>", "M", ">"]
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 2, 5, 40, 900])))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(["", " ", "x", "x ", " x", "\n", "<P>", "a <S> b", "é" * 9000, "word " * 5000, " " * 10_000, ("é😀 " * 4000) + " ", "<M", "> <S"])]
    return rows + [(None, "no id at all here"), (None, None), (7, None), (3, "same id, other text"), (3, "same id, other text")]


@pytest.mark.parametrize("block", [4096, 5])
def test_fill_in_middle(spark, monkeypatch, block):
    """Mixed scripts, white space runs, cuts on block edges, half markers, null and empty texts, repeated rows, clashing names."""
    rows = fim_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fim", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    if block == 4096:
        found = fim.fill_in_middle(df)
        assert sorted(found.columns) == sorted(df.columns)
        got = [(r.doc_id, r.text, tuple(r.fim)) for r in found.collect()]
        back = {r.output_sha256: r.restored_sha256 for r in fim.digest(found).collect()}
        for _, text, (_, _, _, _, output) in got:
            assert back[hashlib.sha256(output.encode()).hexdigest()] == hashlib.sha256((text or "").encode()).hexdigest()
        assert {f[1] for _, _, f in got} == {"plain", "psm", "spm"}
        assert fim.fill_in_middle(df.limit(0)).count() == 0
        assert sorted(got, key=str) == sorted(((i, t, slow_fim(i, t)) for i, t in rows), key=str)
    monkeypatch.setattr(fim, "BLOCK", block)
    monkeypatch.setattr(fim, "STRIDE", 4 * block)
    texts = [(t or "").encode() for _, t in rows]
    offsets = np.cumsum([0, *map(len, texts)])
    rnd = np.random.default_rng(0)
    first, second = (rnd.integers(0, 1 << 32, len(texts)) for _ in range(2))
    got = fim.cuts(np.frombuffer(b"".join(texts), np.uint8), offsets, first, second)
    for i, t in enumerate(texts):
        units = UNIT.findall(t.decode())
        a, b = sorted((first[i] % (len(units) + 1), second[i] % (len(units) + 1)))
        head, upto = "".join(units[:a]), "".join(units[:b])
        assert [int(x[i]) for x in got] == [len(units), len(head.encode()), len(head), len(upto.encode()), len(upto)]


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def slow_repair(rows):
    """Cheapest (cost, audit, text) over all edits, with at most one inserted turn before a row and two at the end."""
    faults, best = faults_of(rows), None
    gaps = [("",), ("u",), ("a",)]
    for chosen in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["D", "K", "u", "a"] for f in faults]):
        for ins in itertools.product(*[gaps] * len(rows), [("",), ("u",), ("a",), ("u", "a")]):
            cost, audit, out = 0, "", []
            for i in range(len(rows) + 1):
                for x in ins[i]:
                    if x:
                        cost, audit = cost + 2, audit + "I"
                        out.append((repair.ROLES[x], ""))
                if i < len(rows):
                    c, (role, text) = chosen[i], rows[i]
                    cost += {"D": 3, "K": 0}.get(c, 2) + (c != "D" and faults[i] == "truncated")
                    audit += c if c in "DK" else "R"
                    if c != "D":
                        out.append((role if c == "K" else repair.ROLES[c], text))
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    return best


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


def test_repair(spark):
    """Random short conversations with odd roles, ties, repeated rows and nulls, against every edit sequence."""
    rnd = random.Random(5)
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rnd.randint(1, 4)):
            rows.append((conv, rnd.choice([0, 1, 2, 5, None]), rnd.choice(["system", "user", "assistant", "assistant", "user", "", "tool", None]),
                         rnd.choice(["Yes.", "Yes.", "no", " ", "", "Why? ", "a:b\n!", None])))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("no", F.lit(9)).repartition(3)
    want = {}
    groups = {c: [] for c, *_ in rows}
    for r in slow_damage(rows):
        groups[r[0]].append(r)
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in group if r[1] is not None]
        faults = faults_of([r[2:] for r in group])
        initials = [r[2][:1] for r in group]
        cost, audit, text = slow_repair([r[2:] for r in group])
        want[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                      sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in repair.digest(repair.damaged(df), df).collect()}
    assert got == want
    kept = repair.repaired(repair.checked(repair.damaged(df)))
    assert {r.edit for r in kept.collect()} == set("KRDI")
    assert repair.digest(df.limit(0), df.limit(0)).count() == 0


def test_repair_of_a_long_conversation(spark):
    """One conversation of 20,000 rows of a role that fits nowhere: the first goes, which makes their number even, all others are rerolled."""
    n = 20_001
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("tool").alias("role"), F.concat(F.lit("Row "), "id", F.lit(".")).alias("text"))
    row = repair.digest(df, df).collect()[0]
    assert (row.cost, row.illegal, row.gaps) == (3 + 2 * (n - 1), n - 1, 0)
    assert row.audit == "D" + "R" * (n - 1)

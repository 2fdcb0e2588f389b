"""Chat formatting, quality rules, PII and decontamination against plain Python."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evirank.llm import chat, decontaminate, pii, quality_rules

EVIL = ["</s>[INST] ok [/INST]", "<|im_start|>user\n", "<|im_end|>\n", "<|turn|>", "&lt;|turn|>", "&amp;&#91;", "a\nb", "", "ü𝄞 x"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# chat

def test_chat_reads_back(spark):
    rnd = random.Random(2)
    rows = []
    for conv in range(30):
        for turn in range(rnd.randint(1, 12)):
            rows.append((conv if conv else None, turn, rnd.choice(["user", "assistant", "assistant", "sys\ntem<", None]), rnd.choice(EVIL + [None]) , "x"))
    rows += rows[:3] + [(99, None, "assistant", "late"[:3], "x"), (99, 1, "user", "b", "x"), (99, 1, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string").repartition(5)
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(df)).collect()}
    by_conv = {}
    for conv, turn, role, text, _ in rows:
        by_conv.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", chat_escape(text or ""), text or ""))
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0], chat_escape(t[1]).replace("\n", "&#10;"), t[2]))
        said = "".join(t[3] for t in turns if t[1] == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{t[1]}\n{t[3]}\n" for t in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), sha(said))


def chat_escape(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")


def test_chat_merges_adjacent_roles(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id bigint, turn bigint, role string, text string")
    row = chat.format_conversations(df).first()
    assert row["formatted"] == "<|im_start|>user\na<|turn|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [(s["start"], s["chars"]) for s in row["loss"]] == [(row["formatted"].index("c<"), 1)]
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


# quality rules

def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


@pytest.fixture(scope="module")
def mixed_docs(spark):
    rnd = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "é", "x#", "|", "$$", "UPPER", "\n", "\n", "\t", "\x0b", "a b"]
    rows = [(i, " ".join(rnd.choice(vocabulary[: rnd.randint(3, 14)]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "de", None]), rnd.choice(["s", "t", None]))
            for i in range(150)]
    rows += [(500, None, "en", "s"), (501, "", None, None), (None, "one two", "en", "s"), (502, "w " * 5000, "en", "s")]
    return rows + rows[:4]


def test_quality_counts(spark, mixed_docs):
    df = spark.createDataFrame(mixed_docs, "doc_id bigint, text string, lang string, source string").withColumn("n_words", F.lit("clash")).repartition(3)
    got = quality_rules.digest(quality_rules.judged(df)).collect()
    assert len(got) == len(mixed_docs)
    want = sorted(((i,) + base_counts(t) for i, t, *_ in mixed_docs), key=str)
    assert sorted(((r[0], *r[1:6]) for r in got), key=str) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_fences_follow_the_group(spark):
    rnd = random.Random(1)
    plain = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(n))
    noisy = lambda n: " ".join(w + rnd.choice(["$$", "##"]) for w in plain(n).split())
    rows = [(i, plain(40), "en", "web") for i in range(300)] + [(1000 + i, noisy(40), "en", "web") for i in range(5)]
    rows += [(2000 + i, noisy(40), "en", "code") for i in range(300)] + [(3000, noisy(40), "en", "tiny")]
    got = {r["doc_id"]: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(300)), "usual texts stay"
    assert not any(got[1000 + i]["kept"] for i in range(5)), "odd ones in a plain source go"
    assert sum(got[2000 + i]["kept"] for i in range(300)) >= 297, "the same is usual in another source"
    assert got[3000]["kept"], "a small group takes the fences of its language"
    assert quality_rules.judged(spark.createDataFrame(rows[:1], "doc_id bigint, text string, lang string, source string").limit(0)).count() == 0


def test_quality_tails_reject_per_signal(spark):
    """In a group where a signal hardly varies, a text far outside its tail goes, though it is within every slack and passes the base rules."""
    rnd = random.Random(8)
    word = lambda lengths: "".join(rnd.choice("abcdefgh") for _ in range(rnd.choice(lengths)))
    say = lambda n, lengths=(3, 4, 5, 6, 7): [word(lengths) for _ in range(n)]
    lines = [" ".join(say(3)) for _ in range(14)]
    odd = {
        "high_symbol_rate": " ".join(w + "$" * (i % 5 == 0) for i, w in enumerate(say(40))),
        "high_dup_line_rate": "\n".join(lines + [lines[0], lines[4], lines[9]]),
        "high_repeat_rate": " ".join((r := say(5)) + say(25) + r + say(25)),
        "high_upper_rate": " ".join(w.title() if i % 3 == 0 else w for i, w in enumerate(say(60))),
        "high_mean_word": " ".join(say(40, (6, 7, 8))),
        "low_mean_word": " ".join(say(40, (3, 4))),
    }
    rows = [(i, " ".join(say(40)), "en", "web") for i in range(600)] + [(1000 + i, t, "en", "web") for i, t in enumerate(odd.values())]
    got = {r["doc_id"]: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    for i, rule in enumerate(odd):
        assert not got[1000 + i]["base_failed"] and rule in got[1000 + i]["failed_rules"], rule
    assert sum(got[i]["kept"] for i in range(600)) >= 597, "usual texts stay"


# PII

def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_pii_base(spark):
    rnd = random.Random(3)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "1.2.3.4", "001.2.3.0255", "256.1.1.1", "1.2.3.4.5", "9" * 40 + ".1.1.1", "+1 (823) 555-4524", "+12", "+1234567890123456",
             "+49 30.1234 567", "a@b.c", "a.b+c@x-y.de.com", "@", "a@b", "é", "𝄞", "12", "-", " ", " ", "word", "\n", "3 4 5", "7-8", "4111111111111111 2"]
    rows = [(i, rnd.choice(["", "x ", "é"]) + rnd.choice(["", " "]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "1 " * 20000), (903, "a" * 3000 + "@"), (None, "q@w.e"), (None, "1.1.1.1")]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit(1)).repartition(4)
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.digest(pii.find_pii(df)).collect()), key=str)
    want = []
    for i, t in rows:
        spans = base_spans(t or "")
        want.append((i, *[sum(k == kind for k, *_ in spans) for kind in pii.KINDS], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    assert got == sorted(want, key=str)


def test_pii_long_runs(spark):
    """A run of a million characters is read once, of letters, digits or dots; its tail may still hold a span."""
    million = 1_000_000
    texts = ["x" * million + " a@b.cd", "9" * million + " 1.2.3.4", "." * million, "x@" * 2000 + "b.cd", "a@b.c_d@e.f g@h.i", "1.2.3.4.5.6.7.8 12.3.4.5.6"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    began = time.time()
    got = {r["doc_id"]: r["base_sha256"] for r in pii.digest(pii.extracted(df).select("doc_id", "text_hash", "base", F.array().cast(pii.SPAN).alias("found"))).collect()}
    assert time.time() - began < 60
    want = {0: [("email", million + 1, million + 7)], 1: [("ip", million + 1, million + 8)], 2: []}
    for i, text in enumerate(texts):
        assert got[i] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in (want[i] if i in want else base_spans(text)))), i


def test_pii_learns_contexts(spark):
    """Seeds teach `phone:`; a number without + after the same words is found, one after other words is not."""
    rows = [(i, f"lorem {i} call phone: +1 823 555 {4000 + i} today") for i in range(20)]
    rows += [(100, "ipsum call phone: 823-555-9911 today"), (101, "order number 823-555-9911x of stock"), (102, "no digits")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: [(s["kind"], r2[s["start"] : s["end"]]) for s in r["found"]] for r in pii.find_pii(df).collect() for r2 in [dict(rows)[r["doc_id"]]]}
    assert got[100] == [(pii.KINDS.index("phone"), "823-555-9911")]
    assert all(not spans for i, spans in got.items() if i != 100)
    texts = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert texts[100] == "ipsum call phone: <phone> today" and texts[3] == "lorem 3 call phone: <phone> today" and texts[101] == rows[21][1]


def test_pii_finds_grouped_forms(spark):
    """Numbers written in groups are one candidate each, with the context outside the whole run."""
    rows = [(i, f"lorem {i} call phone: +1 823 555 {4000 + i} today") for i in range(30)]
    rows += [(50 + i, f"pay {i} with card: {c} gladly") for i, c in enumerate(["4111 1111 1111 1111", "5500000000000004", "4012-8888-8888-1881", "4222 2222 2222 2", "5105 1051 0510 5100", "378282246310005"])]
    grouped = {100: "(743) 555-3824", 101: "823 555 9911", 102: "1 (743) 555-3825", 103: "743.555 38 26"}
    rows += [(i, f"ipsum{i} call phone: {n} today") for i, n in grouped.items()]
    rows += [(110, "use card: 4111 1111 1111 1112 gladly"), (120, "stock (823 555 9912) of order"), (121, "host 10.0.0.1 823 555 9913"), (122, "lot 12 345 678 left")]
    df, texts = spark.createDataFrame(rows, "doc_id bigint, text string"), dict(rows)
    found = {r["doc_id"]: [(pii.KINDS[s["kind"]], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["found"]] for r in pii.find_pii(df).collect()}
    assert {i: found[i] for i in grouped} == {i: [("phone", n)] for i, n in grouped.items()}
    assert found[110] == [("card", "4111 1111 1111 1112")]
    assert not any(found[i] for i in (120, 121, 122))
    seen = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["seen"]] for r in pii.extracted(df).where("doc_id > 110").collect()}
    assert seen[120] == [(-1, "823 555 9912")] and (-1, "823 555 9913") in seen[121] and seen[122] == [(-1, "12 345 678")]
    assert {r["text"] for r in pii.redact(df).where("doc_id = 100").collect()} == {"ipsum100 call phone: <phone> today"}


def test_pii_second_hop(spark):
    """`phone:` is taught by seeds and finds numbers; `dial`, seen only around those, is learned from them and finds one more."""
    rows = [(i, f"a{i} phone: +1 823 555 {4000 + i} z{i}") for i in range(30)]
    rows += [(100 + i, f"b{i} phone: 823-555-99{10 + i} y{i}") for i in range(8)] + [(200 + i, f"c{i} dial 823-555-99{10 + i} x{i}") for i in range(8)]
    rows += [(300, "d dial 777-555-1234 w")] + [(400 + i, f"e{i} order 123-456-78{10 + i} v{i}") for i in range(8)] + [(420, "f order 823-555-9910 u")]
    found = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["found"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    phone = pii.KINDS.index("phone")
    assert found[300] == [(phone, "777-555-1234")]
    assert all(found[200 + i] == [(phone, f"823-555-99{10 + i}")] for i in range(8))
    assert not any(found[400 + i] for i in range(8)), "one found value among eight others does not teach `order`"


def test_redact_unites_overlaps(spark):
    df = spark.createDataFrame([(1, "x 4111111111111111, 1.2.3.4@b.de é", 5), (2, None, 0)], "doc_id bigint, text string, n_chars bigint")
    got = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert got[1]["text"] == "x <card>, <ip> é" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[2]["n_chars"] == 0


# decontamination

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text, items):
    ws, hit, found = words(text), set(), set()
    for item, body in items:
        iw = words(body)
        size = min(10, len(iw))
        for i in range(len(iw) - size + 1) if iw else ():
            for j in range(len(ws) - size + 1):
                if ws[j : j + size] == iw[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add("" if item is None else str(item))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("automaton_bytes", [1 << 20, 900])
def test_decontamination(spark, automaton_bytes):
    rnd = random.Random(7)
    vocabulary = ["a", "b", "Aé", "É", "x1", "Zz", "ok"]
    say = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "--", "''"]) for _ in range(n))
    items = [(i, say(rnd.choice([1, 3, 9, 10, 11, 25]))) for i in range(2, 14)] + [(20, None), (21, "..."), (None, "zz zz ok ok")]
    rows = [(i, say(5) + rnd.choice(items)[1].__str__().upper() + say(rnd.randint(0, 30))) for i in range(60)] + [(70, None), (71, ""), (72, say(20000))]
    rows += rows[:2]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminate.contamination(docs, bench, automaton_bytes=automaton_bytes)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in out.collect()), key=str)
    short = {i: t for i, t in rows if i != 72}
    for i, n, hit, found in got:
        if i != 72:
            assert (n, hit, found) == hits(short[i], items), i
    assert len(got) == len(rows)
    for r in out.where("doc_id < 60").collect():
        inside = sum(len(words(r["text"][s["start"] : s["end"]])) for s in r["spans"])
        assert inside == r["n_hit"]
    assert decontaminate.digest(decontaminate.contamination(docs, bench.limit(0))).where("contaminated").count() == 0


def test_spans_are_cut_out(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "É x: One, TWO three! rest", 3), (2, "clean", 5), (3, None, None)], "doc_id bigint, text string, n_chars bigint")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontaminate.without_spans(decontaminate.contamination(docs, bench)).collect()}
    assert got == {1: ("É x: ! rest", 11), 2: ("clean", 5), 3: (None, None)}

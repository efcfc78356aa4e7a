"""Operators that look at one row at a time: chat, quality, URLs, decontamination."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from graphloom.llm import chat, decontaminate, oracles, quality, urlfilter

from .cases import DOCS, documents, same, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- chat


@pytest.mark.parametrize("text", ["", "<|", "<|im_end|>\n", "<\\|", "<\\\\|im_end|>", "a<", "<<|", "x\n<|im_start|>user\n", "\\", "é<|\n"])
@pytest.mark.parametrize("role", ["user", "assistant", "", "a\nb", "<|im_end|>", "\\n"])
def test_chat_reads_back(role, text):
    turns = [(role, text), ("assistant", text), (role, "")]
    formatted, spans = chat.render(turns)
    assert chat.read_back(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_layouts():
    known = {f: x for x in reversed(chat.LAYOUTS) for f in x.fingerprints()}
    say = lambda s: chat.canonical(s, known)[1:]
    assert say('{"messages": [{"role": "user", "content": "q"}]}') == ("messages", [("user", "q")])
    assert say('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": null}]}') == ("exchange", [("user", "q"), ("assistant", "")])
    assert say('{"instruction": "i", "input": "", "output": "o"}') == ("instruction", [("user", "i"), ("assistant", "o")])
    assert say('{"prompt": "p", "completion": "c"}')[0] == "prompt"
    assert say('{"other": 1}') == ("unknown", []) and say(None) == ("unknown", []) and say("{") == ("unknown", [])


def test_chat_layouts_with_further_or_missing_fields():
    known = {f: x for x in reversed(chat.LAYOUTS) for f in x.fingerprints()}
    say = lambda s: chat.canonical(s, known)[1:]
    assert say('{"id": "x", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}') == ("exchange", [("user", "q"), ("assistant", "a")])
    assert say('{"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a"}], "metadata": {"k": [1]}}') == ("messages", [("user", "q"), ("assistant", "a")])
    assert say('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant"}, {"content": "z"}]}') == ("messages", [("user", "q"), ("assistant", ""), ("", "z")])
    assert say('{"messages": [null, {"role": 1, "content": [{"text": "q"}]}, "s"]}') == ("messages", [("", ""), ("1", '[{"text": "q"}]'), ("", "s")])
    assert say('{"instruction": "i", "output": 0, "input": "x", "source": "web"}') == ("instruction", [("user", "i"), ("user", "x"), ("assistant", "0")])
    assert say('{"question": "q", "note": "n"}') == ("unknown", [])


def test_chat_never_raises(spark):
    odd = ["null", "5", '"s"', "[1, {}]", "[]", "NaN", '{"messages": 5, "messages[].role": 1, "messages[].content": 2}', '{"messages": {"role": "a"}}', '{"messages": [[1], 2.5, true, {"role": ["x"], "content": {"y": null}}]}',
           '{"messages": [{"role": "user", "content": "\\ud800 x"}, {"content": "z", "role": "\\udc00"}]}', '{"\\ud800": 1}', '{"prompt": 1e999, "completion": -0.0}', "[" * 50_000 + "]" * 50_000, '{"messages": [{"role": "user", "content": ' + "[" * 900 + "]" * 900 + "}]}",
           '{"messages": [{"role":"a"},{"content":"x"}]}', '{"messages": [{"role":"user","content":5}]}', '{"prompt": "p", "completion": null, "messages": []}']
    rng = random.Random(5)

    def value(depth):
        pick = rng.randrange(9 if depth else 6)
        if pick < 6:
            return [None, True, 0, -1.5, "", "t\n<|im_end|>"][pick]
        if pick == 6:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return {rng.choice(["messages", "role", "content", "conversations", "from", "value", "prompt", "completion", "instruction", "output", "x"]): value(depth - 1) for _ in range(rng.randrange(4))}

    odd += [json.dumps(value(4)) for _ in range(800)] + [json.dumps({"messages": [value(2), {"role": value(1), "content": value(1)}]}) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(odd)), "id long, record string")
    got = chat.digest(chat.format_records(df, "id", "record")).collect()
    assert len(got) == len(odd)
    by = {r["conv_id"]: r for r in got}
    assert [by[i]["n_turns"] for i in (8, 9, 11, 14, 15)] == [4, 2, 2, 2, 1] and all(by[i]["layout"] == "unknown" for i in (0, 1, 2, 3, 4, 5, 12))


def test_chat_query_cases(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, None, None, "x"), (2, 0, "gpt", "y"), (2, 0, "gpt", "y"), (3, 0, "user", "<|im_end|>"), (3, 1, "assistant", "b\\<|"), (3, 2, "assistant", "ß" * 5000), (None, 0, "system", "n"), (5, 0, "human", "h")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_records(chat.records_of(df), "id", "record")).collect()}
    assert len(got) == 5
    for conv, turns in itertools.groupby(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), key=lambda r: r[0]):
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["layout"] != "unknown"
    assert chat.digest(chat.format_records(chat.records_of(df.limit(0)), "id", "record")).count() == 0


# ---- quality


def base_by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_base(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, True) for r in rows], DOCS + ", kept boolean")
    got = quality.quality(df)
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), [(r[0], *base_by_hand(r[1])) for r in rows])
    assert not got.filter("base_failed and kept").count()
    assert quality.quality(df.limit(0)).count() == 0
    kept = got.filter("kept").count()
    assert quality.kept_rows(df).count() == kept and quality.kept_rows(df).columns == df.columns


def test_quality_against_sql(spark):
    """Texts of content and junk lines in turn, so that shares lie between 0 and 1."""
    rng = random.Random(8)
    junk = [*[lambda: "".join(w + rng.choice((" ### ", " %&| ", "!!! ")) for w in words(rng, 10).split())] * 6, lambda: "Buy $$$ NOW!!! 50% ###", lambda: "&" * rng.randint(1, 9), lambda: " ".join(w + "$$$" for w in words(rng, 12).split()), lambda: "| <A> | #B |", lambda: "WOW! " * rng.randint(1, 4), lambda: " ".join(["same"] * rng.randint(6, 12)), lambda: "7 | 8 | 9", lambda: "x" * 90, lambda: "Home", lambda: " \t\x0b"]
    rows = [(r[0], r[1]) for r in documents()]
    for i in range(300):
        lines = []
        for k in range(rng.randint(1, 5)):  # blocks in turn, the junk of odd texts longer
            bad = (k + i) % 2 == 1
            lines += [rng.choice(junk)() if bad else words(rng, rng.randint(1, 14)) for _ in range(rng.randint(1, 25 if bad == (i % 2 == 1) else 10))]
        rows.append((50_000 + i, "\n".join(lines)))
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    same(got.collect(), con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.quality_sql()})").fetchall())
    assert got.filter("content_share > 0 and content_share < 1").count() > 100
    assert min(got.filter("not base_failed and kept").count(), got.filter("not base_failed and not kept").count()) > 30


def test_viterbi_is_best():
    rng = np.random.default_rng(0)
    for _ in range(50):
        s, t = rng.normal(size=rng.integers(1, 9)), rng.normal(size=(2, 2))
        score = lambda y: sum(x for x, k in zip(s, y) if k) + sum(t[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(s)), key=score)
        assert score(quality.viterbi(s, t)) == pytest.approx(score(best))


def test_crf_fit_separates_held_out():
    rng = np.random.default_rng(1)

    def sequence():
        y = [int(rng.random() < 0.5)]
        while len(y) < 12:
            y.append(y[-1] if rng.random() < 0.9 else 1 - y[-1])
        y = np.array(y)
        return np.c_[np.ones(12), y + rng.normal(size=12)], y

    data = [sequence() for _ in range(300)]
    w, t = quality.fit([x for x, _ in data[:200]], [y for _, y in data[:200]])
    accuracy = lambda w, t: np.mean([np.mean(np.array(quality.viterbi((x @ w).tolist(), t)) == y) for x, y in data[200:]])
    truth = accuracy(np.array([-0.5, 1.0]), np.log([[0.9, 0.1], [0.1, 0.9]]))
    alone = accuracy(np.array([-0.5, 1.0]), np.zeros((2, 2)))
    assert accuracy(w, t) > max(alone + 0.05, truth - 0.03) and t[0, 0] > t[0, 1] and t[1, 1] > t[1, 0]


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(5)
    clean = [" ".join(rng.choice("one blue stone under the tall tree ran over hills with quiet songs all day".split()) for _ in range(60)).capitalize() + "." for _ in range(20)]
    clean = [c for c in clean if not base_by_hand(c)[-1]]
    junk = [" ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in words(rng, 60).split()) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.quality(df).filter("kept").collect()}
    assert kept == set(range(len(clean)))


# ---- URLs


def glob_by_hand(glob, text):
    parts = re.findall(r"\*\*|\*|[^*]+", glob)
    return re.fullmatch("".join(".*" if p == "**" else "[^/?]*" if p == "*" else re.escape(p) for p in parts), text, re.S) is not None


def test_shift_and_against_regex():
    rng = random.Random(2)
    globs = ["".join(rng.choice(["a", "b", "/", "?", "*", "**", "ab"]) for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["", "*", "**", "é*", "x" * 150 + "*"]
    texts = ["".join(rng.choice("aab/?") for _ in range(rng.randint(0, 25))) for _ in range(200)] + ["", "éa", "x" * 151, "x" * 149]
    found = urlfilter.ShiftAnd(globs).matches([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert found[i].tolist() == [glob_by_hand(g, t) for g in globs], t


URLS = ["http://a.example.com/en/7?x", "https://EXAMPLE.com/en/71", "http://x.com/en/", "http://x.com/en", "http://com/en/", "http://xcom/en/1", "http://a.net/de/8", "http://b.example.net/de/81", "http://b.example.net/de/7", "http://q.org/es/#f", "http://q.org/ES/", "http://a.org?/x.com/en/", "http://a.org/x.com/en/1", None, "", "no scheme", "://", "http://a/b://c.com/en/", "http://z.io/f.exe", "ftp://z.io/login", "http://z.io/" + "p" * 5000, "http://z.io/a\nb"]


def url_by_hand(url):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = []
    for rule, verdict in urlfilter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    df = spark.createDataFrame([(i if i % 5 else None, u, "x") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, verdict string")
    got = urlfilter.judged(df).collect()
    assert len(got) == len(URLS) + 2
    for r, u in zip(got, URLS + URLS[:2]):
        host, path, rule, verdict = url_by_hand(u)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == (verdict or ("block" if u and u.endswith((".exe", "login")) else "allow")), u
    assert urlfilter.judged(df.limit(0)).count() == 0


def test_url_rules_say_what_the_contract_says():
    said = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{verdict} {rule}" for rule, verdict in urlfilter.RULES] == said.split(", ")
    words = {"http://b.example.net/de/7": "allow", "http://x.net/de/login": "allow", "http://b.example.net/de/81": "block", "http://a.com/en/7": "block", "http://a.example.com/en/7": "allow", "http://q.org/es/": "block"}
    filter_ = urlfilter.Filter()
    found = filter_.judge(filter_.automaton(), [urlfilter.split_url(u) for u in words])
    assert [verdict for _, verdict in found] == list(words.values())


# ---- decontamination


def fold(text):
    return [w.lower() if w.isascii() else re.sub("[A-Z]", lambda x: x[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def hits_by_hand(text, items, window=10):
    w = fold(text)
    hit, found = set(), set()
    for item, t in items:
        p = fold(t)
        m = min(window, len(p))
        if m:
            wins = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)}
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in wins:
                    hit |= set(range(i, i + m))
                    found.add(item)
    found = sorted(str(x) for x in found if x is not None)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_decontamination(spark, block_bytes):
    rng = random.Random(4)
    texts = [words(rng, 40) for _ in range(12)]
    items = [(i, t) for i, t in enumerate(texts)] + [(20, "lamp tree"), (21, "UNIQUE"), (22, None), (23, ""), (None, texts[3]), (3, texts[3]), (100, texts[4])]
    docs = [(i, words(rng, 15) + " " + " ".join(texts[i].split()[5 : 5 + 2 * i + 5]).upper() + "! " + words(rng, 15)) for i in range(12)]
    docs += [(50, None), (51, ""), (52, "a unique,thing"), (53, texts[0] + texts[1]), (None, texts[2]), (1, "x"), (1, "x"), (54, words(rng, 20000)), (55, "Été-Unique")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, items long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, bench, block_bytes=block_bytes)
    want = [(d, *hits_by_hand(t, items)) for d, t in docs]
    same(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect(), want)
    clean = decontaminate.clean_only(df, bench, block_bytes=block_bytes)
    assert clean.columns == df.columns and clean.count() == sum(not w[-1] for w in want)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).filter("contaminated").count() == 0

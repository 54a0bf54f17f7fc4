"""Mixing, quality rules, chats, secrets and URLs against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from twinsift.llm import chat, credentials, mixing, quality, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# -- mixing ------------------------------------------------------------------


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    wanted, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (wanted - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not more:
            return {s: 2 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= more


@pytest.mark.parametrize("which", ["small", "odd"])
def test_mixing(which, small_docs, odd_docs):
    docs = small_docs if which == "small" else odd_docs
    given = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in given:
        sizes[r.source] += len(words(r.text))
    targets = expected_targets(sizes)
    out = mixing.mix_sources(docs).collect()
    assert Counter((r.doc_id, len(words(r.text)), sizes[r.source], round(targets[r.source], 6)) for r in given) == Counter(
        (r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in out)
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    taken = defaultdict(int)
    for r in out:
        taken[(r.source_size, r.target)] += r.taken
    for (size, target), n in taken.items():
        assert abs(n - target) <= 64 + 0.005 * target
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixing_many_shards(small_docs):
    out = mixing.mix_sources(small_docs, shard_docs=2, block_words=16)
    for r in out.groupBy("source_size", "target").agg(F.sum("taken").alias("n")).collect():
        assert abs(r.n - r.target) <= 16 * 10


def test_sainte_lague(spark):
    votes = {"a": 53_000, "b": 24_000, "c": 23_000, "d": 0, "e": 23_000}
    table = spark.createDataFrame([(k, v, 11) for k, v in votes.items()], "k string, v long, seats int")
    table = table.withColumn("g", F.lit(1))
    best = sorted(((-v / (2 * i + 1), k, i) for k, v in votes.items() if v for i in range(11)))[:11]
    expected = Counter(k for _, k, _ in best)
    for group, globally in ((["g"], False), ([], True)):
        got = mixing.sainte_lague(table, group, "k", "v", "seats", ranked_globally=globally)
        assert {r.k: r.quota for r in got.collect()} == {k: expected[k] for k in votes}


def test_mixing_rows_of_one_id(spark):
    """A third of the rows without id, a third equal: no shard takes them all."""
    rows = [(None, f"word{i} and more", "a") for i in range(400)] + [(7, "the same text", "a")] * 400
    rows += [(i + 1000, f"text{i} of its own", "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = mixing.in_runs(docs.withColumn("_by_text", mixing.text_hash("text", 1)))
    assert runs.agg(F.sum("_copies"), F.max("_copies")).first() == (len(rows), 64)
    shard = F.pmod(F.xxhash64("doc_id", "_by_text", "_run"), F.lit(12)).alias("s")
    shards = runs.select(shard, "_copies").groupBy("s").agg(F.sum("_copies").alias("n"))
    assert max(r.n for r in shards.collect()) < 400
    out = mixing.mix_sources(docs, shard_docs=100, block_words=8)
    found = out.groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in found if r["count"] > 1} == {None: 400, 7: 400}
    total = out.agg(F.sum("taken"), F.sum("size")).first()
    assert abs(total[0] - 1.5 * total[1]) <= 8 * 13
    assert out.where("taken > 2 * size").isEmpty()
    again = mixing.mix_sources(docs.repartition(7), shard_docs=100, block_words=8)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_mixing_nothing(no_docs):
    assert mixing.mix_sources(no_docs).count() == 0


# -- quality -----------------------------------------------------------------


def measured(text):
    text = text or ""
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if seen[t] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside),
            len(w) < 50 or 100 * len(inside) > 50 * len(w))


@pytest.mark.parametrize("which", ["small", "odd"])
def test_quality(which, small_docs, odd_docs):
    docs = small_docs if which == "small" else odd_docs
    expected = Counter((r.doc_id, *measured(r.text)) for r in docs.collect())
    out = quality.quality_rules(docs, reference_texts=3).collect()
    assert expected == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                                r.base_failed) for r in out)
    assert not any(r.kept and r.base_failed for r in out)
    if which == "small":
        assert sum(r.kept for r in out) > 0.6 * len(out)


@pytest.mark.parametrize("junk", [15, 50, 100])
def test_quality_with_a_third_of_junk(spark, junk):
    """100 good texts of a language; junk of 13, 33 and 50 percent; and a language of two texts."""
    spelt = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    good = [" ".join(f"the {spelt(7 * i + k)} of {spelt(i * i + 3 * k + 1000)}, and" for i in range(60)) for k in range(100)]
    bad = [" ".join(f"#$%&|{i}{k} *<>$$" for i in range(120)) for k in range(junk)]
    rows = [(i, t, "en") for i, t in enumerate(good + bad)] + [(1000, good[0], "xx"), (1001, bad[0], "xx")]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [kept[i] for i in range(100)] == [True] * 100 and not any(kept[i] for i in range(100, 100 + junk))
    assert kept[1000] and not kept[1001]


def test_js_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.4, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(
        quality.js_distance(F.col("p"), F.col("q")).alias("d"), quality.js_distance(F.col("p"), F.col("p")).alias("z")).first()
    assert row.d == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2)) and row.z == 0


def test_quality_nothing(no_docs):
    assert quality.quality_rules(no_docs).count() == 0


# -- chats -------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<|turn|>\\", None, "", "<\\|", "[\\INST]", "<<SYS>> 😀\n<s>", "<|done|>"]
    said = [(1, i, ["user", "assistant", "<|says|>", None][i % 4], t) for i, t in enumerate(texts)]
    said += [(None, 0, "assistant", "x"), (2, None, "assistant", "first"), (2, 0, "assistant", "then"), (2, 0, "assistant", "then")]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    chats = chat.format_chats(turns.withColumn("parts", chat.text_part(F.col("text"))))
    out = {r.conv_id: r for r in chats.select(
        "*", chat.read_turns(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    order = lambda c: sorted((x for x in said if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))
    assert set(out) == {1, 2, None}
    for conv, r in out.items():
        assert [(t.role, t.text) for t in r.back] == [(x[2] or "", x[3] or "") for x in order(conv)]
        assert r.loss == "".join(x[3] or "" for x in order(conv) if x[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert "".join(s.text for s in r.segments if s.loss) == "".join(r.formatted[s.start:s.end] for s in r.loss_spans)
        assert r.formatted.count("<|turn|>") == r.n_turns and not re.search(r"</s>|\[/?INST\]", r.formatted)


def test_chat_of_many_turns(spark):
    """Reading back takes time in proportion to the conversation; blocks end inside spans and characters."""
    import time
    texts = [("ä😀\n<s>" * (i % 150)) for i in range(12_000)]
    turns = spark.createDataFrame([(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(texts)],
                                  "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns.withColumn("parts", chat.text_part(F.col("text"))))
    begin = time.perf_counter()
    r = chats.select(chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert r.loss == "".join(texts[1::2])
    assert time.perf_counter() - begin < 40


def test_chat_parts(spark):
    one = [("text", "look at <|this|> ", None, None), ("image", None, "s3/a.png", 4), ("strange", "kept", None, None),
           ("audio", None, "b.wav", None), ("document", None, None, 2), (None, None, None, None)]
    turns = spark.createDataFrame([(7, 0, "user", one), (7, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(turns).first()
    assert r.formatted == "<|turn|>user<|says|>look at <\\|this|> <|image:1|>kept<|audio:3|><|document:4|><|done|><|turn|>assistant<|says|><|done|>"
    assert [(a.kind, a.ref, a.part, a.tokens, a.turn) for a in r.attachments] == [
        ("image", "s3/a.png", 1, 1024, 1), ("audio", "b.wav", 3, 25, 1), ("document", None, 4, 1024, 1)]
    assert r.tokens == 3 + 1024 + 1 + 25 + 1024


def test_chat_nothing(spark):
    empty = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    assert chat.format_chats(empty).count() == 0


# -- secrets -----------------------------------------------------------------

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(g)) >= n]
    return sorted(found)


@pytest.mark.parametrize("which", ["small", "odd", "made"])
def test_secrets(which, spark, small_docs, odd_docs):
    made = ["token=token:abcdef api_key = 'aaaaaa'", "😀 PASSWORD:'12345' Passwd=1234567 secrettoken: x.y-z_=", "ab" * 12 + "g" + "0" * 23,
            "AKIA" + "AKIA" + "X" * 9 + " AKIA" + "Z" * 16, "token=a token=abcdefg" * 50, "tokeN\"  =   \"qwertyui"]
    docs = {"small": small_docs, "odd": odd_docs}.get(which) or spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    out = credentials.secret_spans(docs).collect()
    got = Counter((r.doc_id, tuple((s.start, s.kind_no, s.end) for s in r.found if s.kind_no < 3)) for r in out)
    assert got == Counter((r.doc_id, tuple(base_spans(r.text))) for r in docs.collect())
    if which != "small":
        assert sum(len(r.found) for r in out) > 0


def test_linking(spark):
    value = "Ab1" + "xYz09" * 5
    texts = [f"login: admin42 uses {value}", f"nothing but {value} here", "login: admin42 alone", f"login: admin42 {'far ' * 60}{value}",
             f"https://db.example.net/x {value}", f"token={value} at https://db.example.net/x", "see https://www.example.org/"]
    out = {r.doc_id: [credentials.KINDS[s.kind_no] for s in r.found] for r in credentials.secret_spans(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: ["identifier", "opaque"], 1: [], 2: [], 3: [], 4: ["endpoint", "opaque"], 5: ["assign", "endpoint"], 6: []}


def test_redact(spark):
    docs = spark.createDataFrame([(1, "a password=abcdef b"), (2, None), (3, "clean")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in credentials.redact(docs).collect()} == {1: "a [SECRET] b", 2: None, 3: "clean"}


def test_secrets_nothing(no_docs):
    assert credentials.secret_spans(no_docs).count() == 0


# -- URLs --------------------------------------------------------------------


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host, path):
    fits = [(len(t), k, t) for k, t in urls.RULES for n, _, p in [t.partition("/")]
            if (host == n or host.endswith("." + n)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark, folder):
    odd = [None, "", "no scheme", "http://EXAMPLE.org/es/1", "x://example.org", "://a.com/fr/?q=1&r=2#f", "http://ä.COM/de/x#://", "http://org/",
           "http://sub.example.org/en/12/3", "http://notexample.org/es/", "http://com/de/"]
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").unionByName(
        spark.createDataFrame([(-1 - i, u) for i, u in enumerate(odd)], "page_id long, url string")).withColumn("verdict", F.lit("clash"))
    out = {r.page_id: r for r in urls.filter_urls(pages).collect()}
    for r in pages.collect():
        host, path = split_url(r.url)
        verdict, rule = rule_of(host, path)
        got = out[r.page_id]
        assert (got.host, got.path, got.rule) == (host, path, rule)
        assert got.verdict == verdict if rule else got.verdict in ("allow", "block")


def test_url_trees_learn(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.test/{'good' if i % 2 else 'bad-bad-bad-bad'}/{i}") for i in range(300)], "page_id long, url string")
    rules = [("allow", f"h{i}.test/good") for i in range(1, 200, 2)] + [("block", f"h{i}.test/bad") for i in range(0, 200, 2)]
    out = urls.filter_urls(pages, rules=rules).where("rule is null").collect()
    assert len(out) == 100 and all((r.verdict == "allow") == bool(r.page_id % 2) for r in out)


def test_urls_one_label_or_none(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.net/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(pages, rules=[("block", "org/")]).collect()} == {1: "block", 2: "block"}
    assert {r.verdict for r in urls.filter_urls(pages, rules=[]).collect()} == {"allow"}
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_digests(spark, folder):
    from twinsift.llm.queries import QUERIES
    out = {r.conv_id: r for r in QUERIES["op7_chat_format"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect()
    chats = defaultdict(list)
    for r in rows:
        chats[r.conv_id].append((r.role, r.text or ""))
    chats[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, said in chats.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)))
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), sha(loss))


def test_secrets_of_very_long_runs_and_many_matches(spark):
    """Base64 and paths of a megabyte, forty thousand matches: time in proportion to the text."""
    import random
    import time
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    base64 = "".join(rng.choice(letters) for _ in range(1 << 20))
    texts = ["a/" * (1 << 19), base64, "token=abcdef1 " * 40_000, ("user=ann https://h/x " + "q" * 30 + " ") * 9_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    begin = time.perf_counter()
    found = {r.doc_id: r.n for r in credentials.secret_spans(docs).select("doc_id", F.size("found").alias("n")).collect()}
    clean = {r.doc_id: r.text for r in credentials.redact(docs).collect()}
    assert time.perf_counter() - begin < 40
    assert found[0] == 0 and clean[0] == texts[0] and found[2] == 40_000
    assert clean[2] == "[SECRET] " * 40_000


def opaque_spans(text):
    pattern = re.compile(r"\b(?=[A-Za-z0-9+/_-]{20})(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}")
    return [(m.start(), m.end()) for m in pattern.finditer(text)]


def test_opaque_values_and_redaction(spark):
    """Opaque values as by look-ahead, and marks over spans that overlap, against plain Python."""
    import random
    rng = random.Random(5)
    parts = ["user=bob ", "https://a.b/c?", "Ab1", "x9Q-", "/", "+", "zzzz", "0123456789", "ABCDEFGH", " ", "\n", "€", "\U0001f600", "deadbeef" * 3,
             "AKIA" + "Z" * 16, "secret: hunter22 ", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None]
    docs = spark.createDataFrame([(i, t, "c", "d", i) for i, t in enumerate(texts)], "doc_id long, text string, found string, _text string, `_row` long")
    opaque = credentials.KINDS.index("opaque")
    spans = {r["doc_id"]: r["found"] for r in credentials.secret_spans(docs, scope=10**6).collect()}
    for i, t in enumerate(texts):
        got = {(s.start, s.end) for s in spans[i] if s.kind_no == opaque}
        assert got <= set(opaque_spans(t or ""))
        strong = [(a, b) for a, k, b in base_spans(t)]
        other = any(s.kind_no in (1, 3, 5) for s in spans[i])
        if other:
            assert got == {(a, b) for a, b in opaque_spans(t or "") if not any(x <= a and b <= y for x, y in strong)}
    out = credentials.redact(docs, scope=10**6)
    assert out.columns == docs.columns
    for r in out.collect():
        text, at, clean = texts[r["doc_id"]], 0, ""
        for s in spans[r["doc_id"]]:
            if s.start >= at:
                clean += text[at:s.start] + "[SECRET]"
            at = max(at, s.end)
        assert r["text"] == (None if text is None else clean + text[at:])
        assert (r["found"], r["_text"], r["_row"]) == ("c", "d", r["doc_id"])

"""The ten operators on small tables: plain-Python versions of the same rules, and awkward rows."""

import datetime
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from logloom.llm import (
    common, decontaminate, exact_dedup, html_extract, line_dedup, minhash, mixing, queries, sharding, suffix_dedup, token_count, toxicity,
)

VOCABULARY = [f"w{i}" for i in range(400)]
LONG = " ".join(VOCABULARY[i * 7 % 400] + str(i % 13) for i in range(30_000))
#: Null id, null and empty texts, repeated rows, ties, a very long text; columns that clash with results and helpers.
SCHEMA = ("doc_id bigint, text string, lang string, source string, score double, shard int, tokens string, kept string, doc string, "
          "n_words int, items string, n_tokens int, text_sha256 string, grp int, _doc int, _x0 string, slot string, size int")
ROWS = [(i, t, g, s, 0.5, 3, "x", "y", "z", 1, "i", 2, "h", 4, 5, "q", "s", 6) for i, t, g, s in [
    (1, "a b c d e f", "en", "src1"), (2, None, None, None), (3, "", "de", "src2"), (None, "a b c d e f", "en", "src1"),
    (4, "a  b c d\te f", "en", "src1"), (4, "a  b c d\te f", "en", "src1"), (5, "x", "fr", "odd"), (6, " \n ", "en", "src3"),
    (7, LONG, "en", "src1"), (8, LONG, "en", "src9"), (9, "Ünïcödé ÉA 漢字 \U0001f642", "fr", ""), (5, "another text of the same id", "en", "src2"),
]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def near_texts(seed, n=60):
    """Random texts, copies with a few words changed, shared passages, exact copies."""
    rng = random.Random(seed)
    passage = rng.choices(VOCABULARY, k=60)
    out = []
    for _ in range(n):
        words = rng.choices(VOCABULARY, k=rng.randint(1, 120))
        if rng.random() < 0.3:
            words = words[: len(words) // 3] + passage + words[len(words) // 3 :]
        out.append(words)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            out.append(copy)
    rng.shuffle(out)
    return [" ".join(w) for w in out]


# ---- 1 -------------------------------------------------------------------------------------------------------


def leaf_levels():
    return [mixing.Level("lang", F.col("lang"), F.expr("CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 1 ELSE 2 END")),
            mixing.Level("source", F.col("source"), F.lit(1))]


def test_mixing_gives_shortages_to_siblings_first(spark):
    rows = [(i, "t " * 10, "en", "small" if i < 2 else "large") for i in range(30)] + [(100 + i, "t " * 10, "de", "x") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    # 300 tokens: en 225, de 75; of en 112 to each source, small has 20 an epoch and 20 in all, large takes the other 205
    got = mixing.mix_sources(docs, leaf_levels(), 0.5, 1).groupBy("lang", "source").agg(F.sum(F.col("tokens") * F.col("n_epochs")).alias("n"))
    assert {(r["lang"], r["source"]): r["n"] for r in got.collect()} == {("en", "small"): 20, ("en", "large"): 200, ("de", "x"): 70}


def test_mixing_epochs_and_prefix(spark):
    rows = [(i, "t " * (i % 5 + 1), "en", "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    tokens = sum(i % 5 + 1 for i in range(200))
    got = mixing.mix_sources(docs, leaf_levels(), 2.4, 3, bucket_rows=7).collect()
    taken = sum(r["tokens"] * r["n_epochs"] for r in got)
    assert {r["n_epochs"] for r in got} == {2, 3} and int(tokens * 2.4) - 5 < taken <= int(tokens * 2.4)
    order = sorted(got, key=lambda r: hashlib.md5(f"17|2|{r['doc_id']}".encode()).hexdigest())
    epochs = [r["n_epochs"] for r in order]
    assert epochs == sorted(epochs, reverse=True)  # the prefix of the seeded order, whatever the buckets


def test_mixing_zero_weight_and_odd_rows(spark, odd, empty):
    levels = [mixing.Level("lang", F.col("lang"), F.expr("CASE WHEN lang = 'fr' THEN 0 ELSE 1 END")), mixing.Level("source", F.col("source"), F.lit(1))]
    got = mixing.mix_sources(odd, levels, 1.0, 2).collect()
    assert len(got) == len(ROWS)
    assert {r["n_epochs"] for r in got if r["lang"] == "fr"} == {0}
    assert {r["tokens"] for r in got if r["doc_id"] in (2, 3, 6)} == {0}
    assert {r["tokens"] for r in got if r["doc_id"] == 7} == {30_000}
    assert mixing.mix_sources(empty, levels, 1.0, 2).count() == 0


# ---- 2 -------------------------------------------------------------------------------------------------------


def test_toxicity_folds_and_excepts(spark):
    lexicon = toxicity.base_lexicon()
    texts = ["you 1D10T", "you іdiot", "you st​upid m0r0n", "the trash can is full", "put it in the trash", "l0ser!", "a clean text", "", None,
             "idiotic is another word", "$tupid a$$hole"]
    got = [r["score"] for r in toxicity.score_toxicity(table(spark, texts), lexicon).orderBy("doc_id").collect()]
    hit = [s > got[7] for s in got]
    assert hit == [True, True, True, False, True, True, False, False, False, False, True]
    assert all(0 <= s <= 1 for s in got)


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(VOCABULARY, k=40)
        toxic = i % 8 == 0
        if toxic:
            words[3], words[20] = "zorb" + rng.choice(["ax", "ek", "on", "ulp"]), "grimp"
        rows.append(" ".join(words))
        labels.append((i, int(toxic)))
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    lexicon = toxicity.learn(docs, marks)
    assert " grimp " in lexicon.weights and " zorb" in lexicon.weights
    got = toxicity.score_toxicity(docs, lexicon).join(marks, "doc_id").where("held_out").collect()
    assert got and all(r["predicted"] == r["toxic"] for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.QUERIES["op2_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r["predicted"] for r in got if r["toxic"] == k] for k in (1, 0))
    assert len(toxic) >= 10 and sum(toxic) / len(toxic) >= 0.8 and sum(clean) / len(clean) <= 0.02


def test_matches_are_those_of_all_places():
    rng = random.Random(7)
    for _ in range(200):
        parts = [" " + "".join(rng.choices("ab", k=rng.randint(1, 4))) + rng.choice(["", " "]) for _ in range(6)]
        lexicon = toxicity.Lexicon({p: rng.randint(1, 5) / 2 for p in parts[:4]}, [f" {p.strip()} {q.strip()} " for p, q in zip(parts[4:], parts)])
        text = f" {' '.join(''.join(rng.choices('ab', k=rng.randint(1, 5))) for _ in range(30))} "
        patterns = lexicon.weights | dict.fromkeys(lexicon.exceptions, 0.0)
        total, covered = 0.0, -1
        for start in range(len(text)):
            here = [p for p in patterns if text.startswith(p, start)]
            if here and (best := max(here, key=len)) in lexicon.exceptions:
                covered = max(covered, start + len(best) - 1)
            elif here and start >= covered:
                total += patterns[best]
        assert toxicity.matches(text, lexicon.automaton()) == pytest.approx(total)


def test_lexicon_leaves_out_chance_and_longer_patterns(spark):
    rows = [(f" common{i} ", 3, 40) for i in range(30_000)]
    rows += [(" idiot ", 30, 0), (" idio", 31, 0), (" idiot", 30, 0), (" grim", 60, 0), (" grimp ", 20, 0), (" grimly ", 20, 0), (" luck ", 5, 1)]
    rows += [(f" {'x' * 60} ", 25, 0), (f" {'x' * 40}", 25, 0)]
    telling = toxicity.significant(spark.createDataFrame(rows, "pattern string, t bigint, c bigint"), 100, 900)
    assert {r["pattern"] for r in telling.collect()} == {r[0] for r in rows if r[1] >= 20}
    # a beginning as frequent as one of its words is left to the word
    assert {r["pattern"] for r in toxicity.shortest(telling).collect()} == {" idiot ", " grim", f" {'x' * 60} "}


def test_lowest_has_the_smallest_hashes(spark):
    rows = spark.range(20_000).withColumn("hash", F.xxhash64("id"))
    some = common.lowest(rows, F.col("hash"), 20_000, 300)
    first = [r["id"] for r in rows.orderBy("hash").limit(300).collect()]
    assert [r["id"] for r in some.orderBy("hash").limit(300).collect()] == first and some.count() < 1_000
    assert common.lowest(rows, F.col("hash"), 20_000, 20_000).count() == 20_000


def test_toxicity_learns_long_words(spark):
    rows = [f"some words of text {i} " + ("z" * 5000 if i % 5 == 0 else "") for i in range(200)]
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    lexicon = toxicity.learn(table(spark, rows), marks)
    assert f" {'z' * 5000} " in lexicon.weights


def test_toxicity_odd_rows(spark, odd, empty):
    lexicon = toxicity.learn(empty, spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, toxic int"))
    got = toxicity.score_toxicity(odd, lexicon)
    assert got.count() == len(ROWS) and got.columns.count("score") == 1 and "shard" in got.columns
    assert toxicity.score_toxicity(empty, lexicon).count() == 0


# ---- 3 -------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy now.</div><article><h1>{0} &amp; more</h1>
<p>First   text &eacute;&#33; with <b>bold</b> and a<br>break.<p>Second {0}, unclosed.</p><ul><li>An item here.</ul></article>
<section class="comments"><p>I like this {0}.</p></section><footer>&copy; {0}</footer>{1}"""


@pytest.fixture(scope="module")
def labeller():
    return html_extract.fit_labeller([PAGE.format(f"page {i}", "</body></html>") for i in range(40)])


def test_extraction(labeller):
    vectors = html_extract.Vectors()
    want = "page 9 & more\nFirst text é! with bold and a break.\nSecond page 9, unclosed.\nAn item here."
    pages = [PAGE.format("page 9", "</body></html>"), PAGE.format("page 9", "<p cla"), None, "", "no markup at all", "<nav>only a menu</nav>"]
    got = html_extract.extract_text(pages, labeller, vectors)
    assert got[:4] == [want, want, "", ""] and got[5] == ""


def test_extraction_without_semantic_tags(labeller):
    page = PAGE.format("page 3", "").replace("<article>", '<div class="post-content">').replace("</article>", "</div>") \
        .replace("<nav>", '<div class="menu">').replace("</nav>", "</div>").replace("<footer>", '<div id="footer">')
    got = html_extract.extract_text([page], labeller, html_extract.Vectors())[0]
    assert got.startswith("page 3 & more\nFirst text") and got.endswith("An item here.") and "Menu" not in got and "like" not in got


def test_blocks_close_as_browsers_do():
    def under(*tags):
        path = html_extract.Path()
        for tag in tags:
            path = path.open(tag)
        return path

    got = [(t, p) for t, p, _ in html_extract.blocks_of("<div><p>a<p>b<ul><li>c<li>d</ul>e</div>f &lt;b&gt; 1 < 2")]
    assert got == [("a", under("div", "p")), ("b", under("div", "p")), ("c", under("div", "ul", "li")), ("d", under("div", "ul", "li")),
                   ("e", under("div")), ("f <b> 1 < 2", under())]
    linked = [(t, x) for t, _, x in html_extract.blocks_of("<p>ab <a href=x>cd <b>ef</b></a></p><p>gh</p><a><div>ij</div></a>kl")]
    assert linked == [("ab cd ef", 5 / 8), ("gh", 0), ("ij", 1), ("kl", 0)]


def test_parts_without_text_are_left_out():
    """Equal to the plain pattern, whose searches run to the end of the page for each unfinished tag."""
    names = "script|style|noscript|template|svg|iframe|textarea|select|title"
    plain = re.compile(rf"<!--.*?(?:-->|\Z)|<((?ai:{names}))\b[^>]*>.*?(?:</(?ai:\1)\s*>|\Z)", re.S)
    pieces = ["<script", "<SCRIPT", ">", "</script>", "</Script >", "</script", "<!--", "-->", "--", "-", "<title>", "</title>",
              "a b", "<p>", "<style x='1'>", "</style\n>", "<scripts>", "<\u017ftyle>", "</\u017ftyle>"]
    draw = random.Random(3)
    for _ in range(20_000):
        page = "".join(draw.choices(pieces, k=draw.randint(0, 12)))
        assert html_extract.without_textless(page) == plain.sub("", page), page
    for piece in ("<script ", "<title a ", "<!-- ", "<script></script ", "<p><script x>a</scrip "):
        start = time.perf_counter()
        assert [text for text, _, _ in html_extract.blocks_of("<p>x</p>" + piece * 200_000)] == ["x"]
        assert time.perf_counter() - start < 20


@pytest.mark.parametrize("piece", ["<div>a ", "<div>a </section>", "<p><td><button>a <h1>b</h1>", "<i><div><b>a </i>", "<a<a<a<a<a", "<li>a <table>"])
def test_deep_pages_take_time_by_length(labeller, piece):
    page = piece * 20_000
    began = time.monotonic()
    blocks = html_extract.blocks_of(page + "<" * 5)
    assert time.monotonic() - began < 10
    if piece == "<div>a ":
        assert len(blocks) == 20_000 and blocks[-1][1].depth == 20_000
        assert isinstance(html_extract.extract_text([page], labeller, html_extract.Vectors())[0], str)


def test_probabilities_are_those_of_a_plain_network():
    import math

    import numpy as np

    rng = np.random.default_rng(4)
    model = html_extract.BlockLabeller.fresh(3, 4)
    w = {k: v.astype(float).tolist() for k, v in model.weights.items()}
    pages = [rng.normal(size=(n, html_extract.DIMS)).astype(np.float32) for n in (1, 6, 3)]

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    def states(page, d):
        h, c, out = [0.0] * 4, [0.0] * 4, []
        for x in page if d == "f" else page[::-1]:
            z = [w[f"c{d}"][j] + sum(a * row[j] for a, row in zip(x, w[f"x{d}"])) + sum(a * row[j] for a, row in zip(h, w[f"h{d}"])) for j in range(16)]
            c = [sigmoid(z[4 + j]) * c[j] + sigmoid(z[j]) * math.tanh(z[12 + j]) for j in range(4)]
            h = [sigmoid(z[8 + j]) * math.tanh(c[j]) for j in range(4)]
            out.append(h)
        return out if d == "f" else out[::-1]

    for page, got in zip(pages, model.label(pages)):
        rows = page.astype(float).tolist()
        want = [sigmoid(w["bias"][0] + sum(a * b for a, b in zip(f + b_, w["out"]))) for f, b_ in zip(states(rows, "f"), states(rows, "b"))]
        assert np.allclose(got, want, atol=1e-4)


def test_gradient_is_that_of_the_loss():
    import numpy as np

    rng = np.random.default_rng(2)
    model = html_extract.BlockLabeller.fresh(3, 4)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, mask = rng.normal(size=(3, 5, html_extract.DIMS)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], float)
    y = rng.integers(0, 2, (3, 5)).astype(float)

    def loss():
        p = model.probabilities(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    grad = model.gradient(x, mask, y)
    for name in ("out", "xf", "hf", "cb", "hb"):
        at = tuple(rng.integers(0, s) for s in model.weights[name].shape)
        before = model.weights[name][at]
        model.weights[name][at] = before + 1e-3
        up = loss()
        model.weights[name][at] = before - 1e-3
        down = loss()
        model.weights[name][at] = before
        assert abs((up - down) / 2e-3 - grad[name][at]) < 1e-3


def test_extraction_operator_on_odd_rows(spark, labeller):
    schema = "page_id bigint, html string, text string, n_chars int, url string"
    rows = [(1, PAGE.format("x y", ""), "old", 1, "u"), (None, None, None, None, None), (1, PAGE.format("x y", ""), "old", 1, "u"), (2, "", "", 0, "")]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, schema), labeller)
    assert got.columns == ["page_id", "text", "n_chars", "html", "url"]
    assert sorted(r["n_chars"] for r in got.collect())[:2] == [0, 0] and got.where("page_id = 1").select("text").distinct().count() == 1
    assert html_extract.extract_main_text(spark.createDataFrame([], schema), labeller).count() == 0


# ---- 4 -------------------------------------------------------------------------------------------------------


def test_token_counts_are_the_librarys(spark, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(4)
    letters = [chr(c) for c in range(256)] + list("€漢字Ωéßœ́​ ǅ\U0001f642ﬁ") + [" "] * 40
    texts = ["".join(rng.choices(letters[: 256 if k % 2 else None], k=rng.randint(0, 80))) for k in range(300)]
    texts += ["It's WE'LL x's <|endoftext|> y<|startoftext|>", "<|endoftext|>", None, "", LONG, "a" * 5000, "\x00\x1c\x85\xa0 .,;"]
    got = by_id(token_count.count_tokens(table(spark, texts), path))
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048), repr(t)
    assert token_count.count_tokens(odd, path).count() == len(ROWS)
    assert token_count.count_tokens(empty, path).count() == 0


def test_whole_tokens_encode_alone_as_one():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, whole = Tokenizer.from_file(path), sorted(token_count.whole_tokens(path))
    sample = whole[::50]
    assert len(whole) > 30_000 and all(len(e.ids) == 1 for e in tokenizer.encode_batch(sample, add_special_tokens=False))


def test_cache_may_be_small():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = token_count.whole_tokens(path)
    assert token_count.PieceCounter(path, whole, 2)(LONG) == token_count.PieceCounter(path, whole)(LONG)


# ---- 5 -------------------------------------------------------------------------------------------------------


def shards_hold(rows, texts, n=16):
    counts, slots = Counter(), defaultdict(list)
    for r in rows:
        counts[r["shard"]] += 1
        slots[r["shard"]].append(r["slot"])
        body = texts[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body.encode()) + 1, zlib.crc32(body.encode()), "rows", None)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(n)) <= 1 and set(counts) <= set(range(n))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("kind", ["pairs", "giant", "all", "single", "few"])
def test_shards_are_even_and_keep_groups(spark, kind):
    rng = random.Random(7)
    texts = {
        "pairs": [f"t{i // 2}" for i in range(600)], "giant": ["same"] * 700 + [f"u{i}" for i in range(900)] + [f"p{i // 3}" for i in range(300)],
        "all": ["same"] * 333, "single": [f"x{i}" for i in range(501)], "few": ["a", "a", "b", None, ""],
    }[kind]
    rng.shuffle(texts)
    rows = sharding.shard_documents(table(spark, texts), bucket_rows=20).collect()
    assert len(rows) == len(texts)
    shards_hold(rows, texts)
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]] or ""].add(r["shard"])
    split = [t for t, s in where.items() if len(s) > 1]
    if kind == "pairs":
        assert len(split) <= 75  # random places split 281 of the 300, and only linked rows leave little room
    if kind == "giant":  # 700 of 1900 rows need six shards of 119
        spread = Counter(r["shard"] for r in rows if texts[r["doc_id"]] == "same")
        assert sum(n * n for n in spread.values()) > 1.2 * 700 * 700 / 16 and len(split) <= 60


def test_propagation_never_overfills(spark):
    rows = [(f"g{g}", s, 1, (g * 7 + s) % 16) for g in range(40) for s in range(30)]
    units = spark.createDataFrame(rows, "grp string, salt int, n bigint, label int")
    got = sharding.propagate(units, 90).collect()
    loads = Counter(r["label"] for r in got)
    edges = sum(len({r["label"] for r in got if r["grp"] == f"g{g}"}) for g in range(40))
    assert len(got) == len(rows) and max(loads.values()) <= 90 and edges < 40 * 16 / 3


def test_propagation_goes_on_until_groups_are_whole(spark):
    rng = random.Random(4)
    texts = [f"t{i // 20}" for i in range(16_000)]
    rng.shuffle(texts)
    rows = sharding.shard_documents(table(spark, texts)).collect()
    shards_hold(rows, texts)
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    cut = sum(len(s) > 1 for s in where.values())
    assert cut <= 160, cut


def test_sharding_odd_rows(spark, odd, empty):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == len(ROWS) and sharding.shard_documents(empty).count() == 0
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) <= 1 and "lang" in rows[0].asDict()


# ---- 6 -------------------------------------------------------------------------------------------------------


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or c > "\x7f":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def contaminated(texts, items, size=13):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[s : s + size])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [100_000, 7])
def test_contamination_is_that_of_all_windows(spark, block):
    rng = random.Random(9)
    small = VOCABULARY[:30] + ["É", "é", "ÀB", "İ", "x-y", "ΣΑΣ"]
    items = [(k, " ".join(rng.choices(small, k=rng.choice([1, 4, 13, 14, 30])))) for k in range(25)] + [(30, None), (31, "--- !"), (3, "w1 w2 w3"), (5, "É")]
    texts = [None, "", " .,; "]
    for _ in range(80):
        parts = [" ".join(rng.choices(small, k=rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 2)):
            text = rng.choice(items)[1] or ""
            parts += [text.upper() if text.isascii() else text, " ".join(rng.choices(VOCABULARY, k=rng.randint(0, 100)))]
        texts.append("; ".join(parts))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontaminate.decontaminate(table(spark, texts), bench, block=block))
    for i, want in enumerate(contaminated(texts, items)):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want, texts[i]


def test_contamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a b c d e f"), (None, "x")], "item_id bigint, text string")
    got = decontaminate.decontaminate(odd, bench)
    rows = got.collect()
    assert len(rows) == len(ROWS) and got.columns.count("items") == 1
    assert {r["n_hit"] for r in rows if r["doc_id"] in (1, 4, None)} == {6} and {r["n_words"] for r in rows if r["doc_id"] in (2, 3, 6)} == {0}
    assert decontaminate.decontaminate(empty, bench).count() == 0
    none = decontaminate.decontaminate(odd, bench.limit(0)).collect()
    assert len(none) == len(ROWS) and not any(r["contaminated"] for r in none)


# ---- 7 -------------------------------------------------------------------------------------------------------


def test_lines_are_boilerplate_by_host(spark):
    rows = [(i, "A.example", f"Menu\n text {i} \n\nMenu\nonly {i % 2}") for i in range(8)] + [(20 + i, "b", "Menu") for i in range(2)] \
        + [(30, "c", "Menu"), (31, "c", "other"), (32, "c", "another"), (33, "c", "Menu"), (40, None, None), (41, "", "Menu"), (30, "c", "Menu")]
    pages = spark.createDataFrame(rows, "page_id bigint, where string, body string")
    got = line_dedup.line_dedup(pages, "page_id", F.lower("where"), F.col("body")).collect()
    texts = {(r["page_id"], r["text"]) for r in got}
    assert len(got) == len(rows)
    assert {(0, "text 0\nonly 0"), (1, "text 1\nonly 1"), (20, ""), (21, ""), (40, ""), (41, "Menu"), (31, "other"), (30, "")} <= texts
    alone = line_dedup.line_dedup(pages.where("page_id = 31"), "page_id", F.lower("where"), F.col("body")).collect()
    assert [(r["text"], r["n_dropped"]) for r in alone] == [("other", 0)]
    assert {r["n_dropped"] for r in got if r["page_id"] < 8} == {2} and {r["host_pages"] for r in got if r["host"] == "c"} == {5}


def test_lines_odd_rows(spark, odd, empty):
    got = line_dedup.line_dedup(odd.withColumnRenamed("slot", "host").withColumn("n_lines", F.lit(1)), "doc_id", F.col("source"), F.col("text"))
    assert got.count() == len(ROWS) and got.columns.count("host") == got.columns.count("text") == got.columns.count("n_lines") == 1
    assert line_dedup.line_dedup(empty, "doc_id", F.col("source"), F.col("text")).count() == 0


# ---- 8 -------------------------------------------------------------------------------------------------------


def repeated_bytes(rows, length):
    """Per (id, text): bytes covered by a string that also starts earlier, judged over the whole table."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        mark = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                mark[s : s + length] = [True] * length
            seen.add(raw[s : s + length])
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        spans = sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark))
        out.append((len(raw), sum(mark), spans, sha(kept)))
    return out


@pytest.mark.parametrize("seed,length,gram,hot,block", [(1, 12, 5, 10**9, 1 << 20), (2, 12, 5, 2, 64), (3, 100, 32, 10**9, 1 << 20), (4, 7, 7, 10**9, 300), (5, 20, 3, 1, 1 << 20)])
def test_repeats_are_those_of_all_substrings(spark, seed, length, gram, hot, block):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abé", k=rng.randint(1, 3 * length))) for _ in range(8)]
    texts = [None, "", "a" * (4 * length), "ab" * (2 * length), "a" * length]
    for _ in range(50):
        texts.append("".join(rng.choice(pool) if rng.random() < 0.4 else "".join(rng.choices("abcdefgh", k=rng.randint(0, length))) for _ in range(rng.randint(0, 6))))
    docs = table(spark, texts).repartition(5)
    got = by_id(suffix_dedup.suffix_dedup(docs, length=length, gram=gram, hot=hot, block=block))
    for i, want in enumerate(repeated_bytes(list(enumerate(texts)), length)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, (i, texts[i])


def test_run_index_statistics():
    import numpy as np

    rng = random.Random(3)
    text = np.array([rng.choice([2, 3, 3, 4]) for _ in range(300)] * 2 + [1, 5, 0], np.uint16)
    index = suffix_dedup.RunIndex(text)
    neighbour, shared = index.statistics()
    order = sorted(range(len(text)), key=lambda s: text[s:].tolist())
    assert len(index.begin) < len(text) // 2
    for above, s in zip(order, order[1:]):
        n = 0
        while max(s, above) + n < len(text) and text[s + n] == text[above + n]:
            n += 1
        assert (neighbour[s], shared[s]) == (above, n)


def test_long_texts_are_hashed_in_overlapping_pieces(monkeypatch):
    rng = random.Random(5)
    raw = "".join(rng.choices("abcd ", k=3000)).encode()
    whole = suffix_dedup.anchor_runs(raw, minhash.Powers(), 40, 10)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    parts = suffix_dedup.anchor_runs(raw, minhash.Powers(), 40, 10)
    spread = lambda runs: [a for a, s, e in zip(*(x.tolist() for x in runs)) for _ in range(s, e)]
    assert spread(whole) == spread(parts) and len(spread(whole)) == 3000 - 39


def test_repeats_odd_rows(spark, odd, empty):
    got = suffix_dedup.suffix_dedup(odd)
    rows = got.collect()
    assert len(rows) == len(ROWS) and got.columns.count("kept") == 1
    # what the long text repeats inside itself goes, and all of its copy
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["n_removed"] == by[8]["n_bytes"] and by[8]["kept_sha256"] == sha(b"") and by[8]["n_spans"] == 1
    assert by[7]["n_removed"] == repeated_bytes([(7, LONG)], 100)[0][1]
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_anchor_in_many_different_contexts_is_split(spark):
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    phrase, ending = noise(90), noise(40)
    texts = [noise(50) + phrase + (ending if i % 100 == 0 else "") + noise(50) for i in range(9_000)]
    docs = table(spark, texts).coalesce(1)  # thousands of rows a batch, few batches
    heaviest = suffix_dedup.contexts_by_key(docs).groupBy("key").agg(F.sum("size").alias("n")).agg(F.max("n")).head()[0]
    assert heaviest <= suffix_dedup.BLOCK
    got = by_id(suffix_dedup.suffix_dedup(docs))
    wanted = repeated_bytes(list(enumerate(texts)), 100)
    assert sum(w[1] > 0 for w in wanted) > 80
    for i, want in enumerate(wanted):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i


def test_repeated_rows_do_not_remove_each_other(spark):
    text = "".join(random.Random(8).choices("abcdefgh", k=500))
    docs = spark.createDataFrame([(3, text), (3, text), (None, text[:300]), (4, text)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == [(0, 0), (3, 300), (3, 300), (4, 500)]


# ---- 9 -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [None, lambda norm: F.length(norm) % 3])
def test_exact_copies_by_whole_content(spark, digest):
    rng = random.Random(2)
    texts = [rng.choice(["a", "b", "ab", "abc", "", " "]) + rng.choice(["", " ", "\t", "  \x0b"]) + rng.choice(["c", "", "é"]) for _ in range(300)]
    texts[5] = None
    docs = table(spark, texts).repartition(6)
    got = by_id(exact_dedup.exact_dedup(docs, salts=4, digest=digest))
    norm = [exact(t) for t in texts]
    for i, t in enumerate(texts):
        same = [k for k in range(len(texts)) if norm[k] == norm[i]]
        keep = min(same, key=lambda k: (-len(texts[k] or ""), k))
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(same), keep == i, sha(norm[i]))


def exact(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\f\r")


def test_exact_copies_odd_rows(spark, odd, empty):
    got = exact_dedup.exact_dedup(odd)
    rows = got.collect()
    assert len(rows) == len(ROWS) and got.columns.count("kept") == 1
    same = [r for r in rows if r["text_sha256"] == sha("abcdef")]
    # the two rows of id 4 have more code points and are one document; the null id is never preferred
    assert {r["keep_id"] for r in same} == {4} and {r["group_size"] for r in same} == {4}
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in same) == [(0, False), (1, False), (4, True), (4, True)]
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("kind,ids,first", [
    ("string", ["b", "a10", "a9", None, "é"], "a10"), ("bigint", [3, -5, 0, None, 2**63 - 1], -5), ("date", None, None), ("double", [1.5, -0.5, 2.0, None, 9.0], -0.5),
])
def test_exact_copies_with_ids_of_any_type(spark, kind, ids, first):
    if kind == "date":
        ids, first = [datetime.date(2024, 1, d) for d in (4, 2, 3)] + [None, datetime.date(2024, 2, 1)], datetime.date(2024, 1, 2)
    docs = spark.createDataFrame([(i, "a b") for i in ids] + [(ids[0], "a b c")], f"doc_id {kind}, text string")
    got = exact_dedup.exact_dedup(docs).where("group_size = 5").collect()
    assert len(got) == 5 and {r["keep_id"] for r in got} == {first} and [r["doc_id"] for r in got if r["kept"]] == [first]


# ---- 10 ------------------------------------------------------------------------------------------------------


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def linked(texts, percent=75):
    sets = [shingles(t) for t in texts]
    least = list(range(len(texts)))

    def find(k):
        while least[k] != k:
            k = least[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return [(len(sets[k]), find(k)) for k in range(len(texts))]


@pytest.mark.parametrize("seed,stars", [(1, 3), (2, 0), (3, 1)])
def test_near_copies_are_those_of_all_pairs(spark, seed, stars):
    texts = near_texts(seed) + [None, "", "  ", "one two", "ONE  two", "one two three", "É a b c d e", "é a b c d e"]
    got = by_id(minhash.near_duplicates(table(spark, texts).repartition(5), stars=stars))
    want = linked(texts)
    assert len({c for _, c in want}) < len(texts) - 20
    for i, (n, component) in enumerate(want):
        r = got[i]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (n, component, component == i), texts[i]


def test_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    errors = []
    for n in (3, 40, 400, 5000):
        for share in (0.2, 0.75):
            common = int(n * 2 * share / (1 + share))
            a = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
            b = np.concatenate([a[:common], rng.integers(0, 2**63, n - common, dtype=np.int64).astype(np.uint64)])
            s = minhash.sketch([a, b], 400)
            assert (s != np.uint64(2**64 - 1)).all()
            errors.append((s[0] == s[1]).mean() - common / (2 * n - common))
    assert max(map(abs, errors)) < 0.1


def test_components_of_a_path(spark):
    n = 40
    links = spark.createDataFrame([(bytes([k]), bytes([k + 1])) for k in range(n)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    got = {bytes(r["cls"]): bytes(r["comp"]) for r in minhash.components(links).collect()}
    assert len(got) == n + 3 and {got[bytes([k])] for k in range(n + 1)} == {b"\x00"} and got[b"\xf1"] == b"\xf0"


def test_near_copies_odd_rows(spark, odd, empty):
    got = minhash.near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == len(ROWS) and got.columns.count("kept") == 1
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in rows if r["n_shingles"] == 2) == [
        (0, 1, False), (1, 1, True), (4, 1, False), (4, 1, False), (5, 5, True)]
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] in (7, 8)} == {(7, 7), (8, 7)}
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (4, 8)").count() == 0 and kept.count() == len(ROWS) - 4


def test_words_in_pieces(monkeypatch):
    text = LONG[:5000].encode()
    whole = minhash.word_hashes(text, minhash.Powers())
    monkeypatch.setattr(minhash, "CHUNK", 300)
    assert (minhash.word_hashes(text, minhash.Powers()) == whole).all() and len(whole) == len(text.split())

"""Page extraction, BPE, language, LM scores, near-dedup, media and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import html as markup
import itertools
import random
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, graph, langid, lmscore, mainhtml, minhash, mpegts
from quarry.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
sha = lambda b: hashlib.sha256(b).hexdigest()


# pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Home</a></nav>", ""),
        ("<body><nav>Menu here.</nav><article><h1>Title</h1><p>One &amp; two.<p>Three<br>four.</article><footer>&copy; me.</footer>", "Title One & two. Three four."),
        ("<article><p>A long enough sentence that stands here.</p><div class='comments'><p>First! A reader writes quite a lot here.</p></div></article>", "A long enough sentence that stands here."),
        ("<article><p>Text one is here.</p><aside>Related things to read.</aside><form>Name <input></form><div class='ad'>Buy this now.</div><p>Text two is here.</p></article>", "Text one is here. Text two is here."),
        ("<article class='post has-sidebar'><p>The story is told here.</p><article class=comment><p>I, a reader, beg to differ on most of that.</p></article></article>", "The story is told here."),
        ("<article><p>cut <b>off &am", "cut off &am"),
        ("<article><p>a<script>var x='</p><p>no';</script>b<style>p{}</style><!-- c --> c</p></article>", "ab c"),
        ("<div class='sidebar'><p>Not this one, it is at the side.</p></div><main><p>But this one is what the page is about, as all can see.</p></main>", "But this one is what the page is about, as all can see."),
        ("<div id=cookie-notice>We use cookies. Accept?</div><div id=content><p>" + "A sentence of the story goes on and on. " * 5 + "</p></div>", ("A sentence of the story goes on and on. " * 5).strip()),
        ("<p hidden>unseen words are here.</p><article>\n spaced \t out\n words&nbsp;here. </article>", "spaced out words here."),
    ],
)
def test_main_text(page, text):
    assert mainhtml.main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><body><article><p>Text.</p></article>",
        "<head><title>T</title><meta charset=utf-8><link rel=x href=y><script>var a</script><article><p>Text.</article>",
        "<head><style>p{}</style><template><p>Not this.</p></template><noscript><p>Nor this.</p></noscript><br><article><p>Text.</p></article>",
        "<head><head><title>T</title><body><article><p>Text.</p></article>",
        "<head><title>T</title></head><body><article><p>Text.</p></article>",
    ],
)
def test_open_head_ends_before_the_body(page):
    assert mainhtml.main_text(page) == "Text."


def test_open_head_ends_at_text():
    assert [b.text for b in mainhtml.blocks("<head><title>T</title>\n Some text <p>and more.")] == ["Some text", "and more."]


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]

        def cost(label, scores=scores, edges=edges):
            return sum(abs(s) for s, k in zip(scores, label, strict=True) if k != (s > 0)) + sum(w for i, j, w in edges if label[i] != label[j])

        assert cost(mainhtml.labels(scores, edges)) <= min(map(cost, itertools.product([False, True], repeat=n))) + 1e-9


def test_articles_of_pages(spark, sf_dir):
    got = {r["page_id"]: r for r in QUERIES["op2_html_extraction"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        want = " ".join(markup.unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_deep_and_long_pages():
    deep = "<article>" + "<div>" * 3000 + "A sentence in the depth." + "<p>More of it here, too.</p>" * 2000
    assert mainhtml.main_text(deep).count("More of it") == 2000


# BPE


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    return np.frombuffer(bpe.encoder(PATH, PATTERN).packed(text), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library(library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids_of(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "a" * 700, " " * 300 + "x", "日本語🙂🙂 don't I'LL 123456789", "\n\n\t \r\n x", "aaaa" * 500 + "b", "<|endoftext|>"])
def test_bpe_odd_texts(library, text):
    assert ids_of(text) == library.encode_ordinary(text)


def test_prefix_table_appends_and_edits():
    v, rng = bpe.vocabulary(PATH), random.Random(4)
    for _ in range(150):
        data = bytes(rng.choice(b"abcdetion ") for _ in range(90))
        cut = rng.randint(0, 90)
        table = bpe.PrefixTable(v, data[:cut])
        table.append(data[cut:])
        assert table.ids() == v.merged(data)
        a = rng.randint(0, 89)
        b, new = rng.randint(a, min(90, a + 6)), bytes(rng.choice(b"abcdetion ") for _ in range(rng.randint(0, 5)))
        table.replace(a, b, new)
        assert table.ids() == v.merged(data[:a] + new + data[b:]) and len(table.last) == len(table.data) + 1
    long = bpe.PrefixTable(v, b"hello world thing" * 300)
    assert long.replace(100, 102, b"Q") < 400


def test_bpe_query_round_trip(spark, make, library):
    rows = [None, "", "Ünïcödé 🙂 text", "word " * 5000]
    done = bpe.with_bytes(bpe.with_ids(make(rows), PATH, PATTERN), PATH)
    got = {r["doc_id"]: r for r in done.collect()}
    for i, t in enumerate(rows):
        assert got[i]["ids"] == library.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode() and got[i]["kept"] == "clash"
    assert bpe.with_ids(make([]), PATH, PATTERN).count() == 0


def test_bpe_query_digests(spark, sf_dir, texts, library):
    for r in QUERIES["op3_byte_bpe"](spark, sf_dir).collect():
        text = texts[r["doc_id"]]["text"]
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))


# language


def test_language_is_learned_and_held_out_accurate(spark, texts):
    rows = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_language_defined_cases(make):
    train = make([(i, t, k, "s") for i, (t, k) in enumerate([("the cat and dog", "en"), ("der hund und katze", "de"), (None, "en"), ("x", None)])])
    model = langid.fit(train)
    got = [r["lang_pred"] for r in langid.with_language(make([None, "", "12 34 !!", "the dog", "und der", "hundkatze", "THE AND"]), model).orderBy("doc_id").collect()]
    assert got == ["und", "und", "und", "en", "de", "de", "en"]
    assert [r["lang_pred"] for r in langid.with_language(make(["text"]), langid.fit(make([]))).collect()] == ["und"]


def test_every_language_of_copies_is_learned(make):
    hot = {f"l{i}": f"wort{chr(97 + i)} rest{chr(97 + i)}" for i in range(8)}
    rows = [(i, text, lang, "s") for i, (lang, text) in enumerate(itertools.chain(*[hot.items()] * 60))]
    model = langid.fit(make(rows), rows=2)
    assert all(w in model["rows"] for text in hot.values() for w in text.split())
    got = langid.with_language(make(rows[:8]), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
    weighed = langid.fit(make([(i, "aa bb" if i else "aa", "x", "s") for i in range(4)]), rows=10)
    aa, bb = (weighed["values"][weighed["rows"][w], 0] for w in ("aa", "bb"))
    assert aa - bb == pytest.approx(np.log(4.5 / 3.5), abs=1e-5)  # copies count as often as they come


def test_backoff_takes_the_longest_known_order(make):
    own = langid.Identifier(langid.fit(make([("1", "abcdef", "en", "s")] and [(1, "abcdef", "en", "s")])))
    longest = own.backoff("abcdefg")
    assert longest and all(r in set(own.grams[5].values()) for r in longest)
    assert all(r in set(own.grams[1].values()) for r in own.backoff("xaxx")) and own.backoff("zz") == []


# LM scores


def test_lm_scores_equal_a_plain_model(make):
    rng = random.Random(6)
    rows = [" ".join(rng.choice(["a", "b", "c", "Dog!!", "##", "7", "longerword"]) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, ""]
    df = make(rows, extra=False).withColumn("target", F.col("doc_id") % 3 == 0)
    size = 3
    got = {r["doc_id"]: r for r in lmscore.with_scores(df.select("doc_id", "text"), df.select("text", "target"), size).collect()}
    seen = {w: sum(w in brute.words(t) for t in rows) for w in set(brute.words(" ".join(t or "" for t in rows)))}
    tokens = lmscore.Tokens(sorted(seen, key=lambda w: (-seen[w], w))[:size])
    ids = {i: tokens.of((t or "").encode()).tolist() for i, t in enumerate(rows)}

    def model(docs):
        c = np.zeros((tokens.size, tokens.size))
        for i in docs:
            for h, w in zip(ids[i], ids[i][1:], strict=False):
                c[h, w] += 1
        p = (c.sum(0) + 1) / (c.sum() + tokens.size)
        return -np.log((c + lmscore.MU * p) / (c.sum(1, keepdims=True) + lmscore.MU))

    target, background = model([i for i in ids if i % 3 == 0]), model(list(ids))
    for i, seq in ids.items():
        n = len(seq) - 1
        want = [np.mean([m[h, w] for h, w in zip(seq, seq[1:], strict=False)]) if n else 0.0 for m in (target, background)]
        assert got[i]["n_tokens"] == n and got[i]["target_loss"] == pytest.approx(want[0], abs=1e-4) and got[i]["score"] == pytest.approx(want[0] - want[1], abs=1e-4)


def test_lm_scores_part_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = QUERIES["op6_lm_scoring"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("quality", "score").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([[a < b for b in bad] for a in good]) > 0.95


def test_lm_vocabulary_and_pairs_grow_with_the_corpus(make):
    common = [f"f{i:04d}" for i in range(1030)]
    rows = [" ".join(common)] * 3 + ["apple pear"] * 2 + ["plumb kiwis"] * 2 + [None]
    df = make(rows, extra=False).withColumn("target", F.col("doc_id").isin(3, 4))
    got = {r["doc_id"]: r for r in lmscore.with_scores(df.select("doc_id", "text"), df.select("text", "target")).collect()}
    assert got[3]["score"] < got[5]["score"] - 1  # content words of one shape, beyond the 1,024 most frequent
    n, size, mu = 3 * 1030 + 8, 1030 + 4 + 2, lmscore.MU
    want = [np.log(7 + mu) - np.log(2 + mu * 3 / (n + size)), np.log(2 + mu) - np.log(2 + mu * 3 / (n + size))]
    assert got[3]["background_loss"] == pytest.approx(np.mean(want)) and got[3]["n_tokens"] == 2 and got[0]["n_tokens"] == 1030
    part = {r["doc_id"]: r for r in lmscore.with_scores(df.select("doc_id", "text"), df.filter("doc_id < 5").select("text", "target")).collect()}
    seen, size = 3 * 1030 + 4, 1030 + 2 + 2
    want = [np.log(5 + mu) - np.log(mu / (seen + size)), np.log(mu) - np.log(mu / (seen + size))]
    assert part[5]["background_loss"] == pytest.approx(np.mean(want))  # words of no counted text


def test_lm_scores_of_empty_tables(make):
    df = make([], extra=False)
    assert lmscore.with_scores(df.select("doc_id", "text"), df.select("text", F.lit(True).alias("target"))).count() == 0


# near duplicates


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 400)
    for share in (0.9, 0.6, 0.2):
        other = np.concatenate([base[: int(400 * share)], rng.integers(-(2**63), 2**63, 400 - int(400 * share))])
        table = minhash.signatures(np.concatenate([base, other]), np.array([400, 400]))
        j = share / (2 - share)
        assert abs((table[0] == table[1]).mean() - j) < 0.16


def plain_signature(values):
    """SuperMinHash one element at a time, all steps."""
    least = np.full(minhash.PLACES, np.inf)
    for v in values:
        seed = minhash.mixed(np.array([v], np.int64).view(np.uint64) + minhash.GOLDEN)
        order = list(range(minhash.PLACES))
        for step in range(minhash.PLACES):
            if step == 0:
                at, fraction = int(seed[0] % np.uint64(minhash.PLACES)), minhash.mixed(seed + minhash.GOLDEN)
            else:
                draw = minhash.mixed(seed + minhash.golden(2 * step))
                at, fraction = step + int(draw[0] % np.uint64(minhash.PLACES - step)), minhash.mixed(draw + minhash.GOLDEN)
            order[step], order[at] = order[at], order[step]
            least[order[step]] = min(least[order[step]], step + float(fraction[0] >> np.uint64(11)) * 2.0**-53)
    return least


@pytest.mark.parametrize("size", [1, 2, 7, 60, 300])
def test_early_stopping_changes_nothing(size):
    values = np.random.default_rng(size).integers(-(2**63), 2**63, size)
    pad = np.random.default_rng(9).integers(-(2**63), 2**63, 50)
    table = minhash.signatures(np.concatenate([pad, values]), np.array([50, 0, size]))
    assert np.array_equal(table[2], plain_signature(values))


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(100)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2060)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in pairs)}


def variants(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_groups_equal_all_pairs(make):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    other = [f"u{rng.randrange(10**6)}" for _ in range(60)]
    rows = variants(rng, base, 120, 8) + variants(rng, other, 25, 3) + ["Same Words here", "same words HERE", "one", "One", "two words", "", None, " \n "] + [" ".join(base)] * 20 + [" ".join(f"x{i}_{k}" for k in range(30)) for i in range(30)]
    rng.shuffle(rows)
    sets = {i: brute.shingles(t) for i, t in enumerate(rows)}
    want = brute.components(sets)
    got = {r["doc_id"]: r for r in minhash.groups(make(rows)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_groups_of_empty_tables_and_null_ids(make):
    assert minhash.groups(make([])).count() == 0
    rows = [(None, "a b c d", None, None), (4, "a b c d", None, None), (4, "a b c d", None, None), (None, "alone in the world", None, None)]
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in minhash.groups(make(rows)).collect()) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]


# media


@pytest.mark.parametrize("n", [0, 1, 183, 184, 191, 192, 193, 376, 16383, 16384, 16385, 200_000])
def test_transport_stream_round_trip(n):
    text = "".join(random.Random(n).choices("abcé\n ", k=n))
    payload = mpegts.padded(text)
    assert payload.startswith(text.encode()) and len(payload) % 192 == 0 and payload
    stream = mpegts.mux(payload)
    got = mpegts.demux(stream)
    assert len(stream) % 188 == 0 and all(stream[i] == 0x47 for i in range(0, len(stream), 188))
    assert got.errors == 0 and got.data == {mpegts.DATA_PID: payload} and got.programs == {1: mpegts.PMT_PID}
    assert [(t, r, o) for _, t, r, o in got.times] == [(i * mpegts.TICKS, i % mpegts.RANDOM_ACCESS == 0, i * mpegts.UNIT) for i in range(-(-len(payload) // mpegts.UNIT))]


def test_damage_is_counted():
    stream = mpegts.mux(mpegts.padded("x" * 50_000))
    assert mpegts.demux(stream[: 188 * 10] + stream[188 * 11 :]).errors >= 1
    assert mpegts.demux(stream[: 188 * 3] + stream[188 * 2 :]).errors == 0  # a repeated packet is no error
    assert mpegts.demux(b"\0" + stream[1:]).errors >= 1 and mpegts.demux(stream[:-5]).errors >= 1
    assert mpegts.demux(stream[:5] + b"\xff" + stream[6:]).errors >= 1 and mpegts.demux(b"").packets == 0


def test_section_checksum_of_a_known_table():
    table = bytes.fromhex("00b00d0001c100000001f000")
    assert mpegts.section_crc(table + mpegts.section_crc(table).to_bytes(4, "big")) == 0
    assert mpegts.section_crc(b"123456789") == 0x0376E6E7  # CRC-32/MPEG-2


def test_media_query(spark, sf_dir, texts):
    for r in QUERIES["op8_mpeg_ts"](spark, sf_dir).collect():
        data = texts[r["doc_id"]]["text"].encode()
        payload = data + b" " * (-len(data) % 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == sha(mpegts.mux(payload)) and r["media_bytes"] % 188 == 0


def test_media_of_odd_rows(make):
    got = mpegts.with_features(mpegts.with_media(make([None, "", "a", "a"]))).orderBy("doc_id").collect()
    assert [r["payload_bytes"] for r in got] == [192] * 4 and got[2]["payload_sha256"] == got[3]["payload_sha256"] and got[0]["n_bytes"] == 0
    assert mpegts.with_features(mpegts.with_media(make([]))).count() == 0


# the pipeline


def test_pipeline_stages(spark, sf_dir, library):
    docs = {"documents": spark.read.parquet(f"{sf_dir}/documents.parquet")}
    frames, now = [], docs["documents"]
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, sf_dir), name.replace(" ", "_"))
        frames.append(now)
    columns = docs["documents"].columns
    assert [f.columns for f in frames[:-1]] == [columns] * 4
    kept, lines, near, mixed, tokens = ([r.asDict() for r in f.collect()] for f in frames)
    whole = {r["doc_id"]: r["text"] for r in docs["documents"].collect()}
    assert all(not brute.quality(whole[r["doc_id"]])[5] for r in kept) and 0 < len(kept) < docs["documents"].count() and len(lines) == len(kept)
    sets = {r["doc_id"]: brute.shingles(r["text"], 5) for r in lines}
    groups = brute.components(sets, 80)
    assert {r["doc_id"] for r in near} == {i for i, c in groups.items() if i == c}
    copies = {}
    for r in mixed:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 2 and set(copies) <= {r["doc_id"] for r in near}
    by_id = {r["doc_id"]: r["text"] for r in near}
    assert len(tokens) == len(mixed) and all(r["ids"] == library.encode_ordinary(by_id[r["doc_id"]] or "") for r in tokens)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(tokens)


def test_pipeline_on_odd_documents(spark, make, tmp_path):
    prose = "This is a perfectly fine sentence number {} with enough different words to be kept, as it should be."
    rows = [(i, prose.format(i) + "\nA line that all of them have in common, word for word.", "en", "s") for i in range(12)] + [(None, None, None, None), (20, "", None, None), (21, "x " * 30_000, None, None), (3, prose.format(3), "en", None)]
    folder = tmp_path / "sf"
    make(rows).write.parquet(str(folder / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(folder))
    assert {r["doc_id"] for r in out.collect()} == set(range(12)) and out.count() >= 12
    make([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0

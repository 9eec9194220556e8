"""Quality rules, secret scans, mixing and line dedup."""

from __future__ import annotations

import hashlib
import random

import brute
import pytest
from duck import assert_same, connect
from pyspark.sql import functions as F

from quarry.llm import credentials, linededup, mixing, quality
from quarry.llm.oracles import ORACLES
from quarry.llm.queries import QUERIES

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
PROSE = "The quick brown fox jumps over the lazy dog and runs into the green forest again."


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", ["op1_quality_rules", "op5_secret_scan", "op9_mixing", "op10_line_dedup"])
def test_native_plans_have_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


ODD = [None, "", " ", "\n\n", "a", "a b c d e", "one two three four five six seven eight nine ten", "x y z " * 400, "a b c d e f a b c d e f g h i j k", "É é\x0bword\x0c\r tail", "a\nb\na\n\n \na", "# * $ | < > & % words here are more than ten of them yes"]


def test_quality_figures(make):
    got = quality.measured(make(ODD)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert [tuple(r)[1:] for r in sorted(got)] == [brute.quality(t) for t in ODD]


def test_quality_random_repeats(make):
    rng = random.Random(5)
    many = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    got = quality.measured(make(many)).select("doc_id", "n_repeat_words").collect()
    assert [r["n_repeat_words"] for r in sorted(got)] == [brute.quality(t)[4] for t in many]


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        (PROSE, False), ("Ein Satz, der mit einem Punkt endet.", False), ("Home | News | Sport | Contact | About", True), ("Wow!! So!! Much!! Shouting!!", True),
        ("the&&& big*** dog$$$ ran%%%", True), ("© 2024 Example", True), ("We use cookies to give you a better visit.", True), ("Menu", True), ("Chapter one begins here, with a long heading", False),
        ("Is this fine?", False), ("He said: “Done.”", False), ("price < 5 and more & more words in a quite ordinary line.", False),
    ],
)
def test_line_rules(spark, line, fails):
    assert spark.createDataFrame([(line,)], "x string").select(quality.line_fails(F.col("x"))).first()[0] is fails


def test_quality_removes_lines_and_rejects_by_loss(make):
    rows = [f"Menu\n{PROSE}\nIt sleeps at last.", "\n".join(["a | b | c | d | e | f | g | h"] * 4 + ["One short line."]), PROSE]
    got = sorted(quality.measured(make(rows)).select("doc_id", "kept", "clean_text").collect())
    assert [r["kept"] for r in got] == [True, False, True]
    assert got[0]["clean_text"] == rows[0][5:] and got[2]["clean_text"] == PROSE


def test_quality_of_labelled_documents(spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = QUERIES["op1_quality_rules"](spark, sf_dir).filter("not base_failed").join(good, "doc_id").groupBy("quality", "kept").count().collect()
    assert {(r["quality"], r["kept"]) for r in rows} == {(1, True), (0, False)}


def found(make, rows):
    return {r["doc_id"]: r["spans"] for r in credentials.findings(make(rows)).select("doc_id", credentials.listed(F.col("spans")).alias("spans")).collect()}


BITS = ["AKIAABCDEFGH123456", "AKIAX", "AKIA" + "B" * 20, 'token = "', "secret=token=abcdefghijkl ", "password: token = abcdefghijklmnop", "PassWd=hunter22", "é🙂", "\n", "\n\n", "abcdef0123456789ab", "deadbeef", " prose words. ", "api_key:'ZZZZZZZZZZZZZ'", 'API_KEY="x"']


def test_strong_findings(make):
    rng = random.Random(3)
    rows = [None, "", "x" * 50_000 + " token=abcdefghijklmnop"] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(250)]
    got = found(make, rows)
    for i, t in enumerate(rows):
        base = [s for s in got[i].split(",") if s and not s.startswith("weak")]
        assert base == [f"{n}:{a}:{b}" for n, a, b in brute.secrets(t)], t


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("passwd=hunter22", ""),
        ("user=bob", ""),
        ("user=bob passwd=hunter22", "weak_access:0:8,weak_secret:9:24"),
        ("user=bob\n\npasswd=hunter22", ""),
        ("user=bob\n" + "x " * 300 + "\npasswd=hunter22", ""),
        ("https://db.example.com", ""),
        ("https://db.example.com user=bob", ""),
        ("https://db.example.com user=bob pwd=hunter2", "weak_endpoint:0:22,weak_access:23:31,weak_secret:32:43"),
        ("AKIAABCDEFGH123456 pwd=hunter2", "access:0:18,weak_secret:19:30"),
        ("client_secret=abcdefghijklmnop", "assign:7:30"),
    ],
)
def test_weak_parts_need_each_other(make, text, spans):
    assert found(make, [text])[0] == spans


def test_many_parts_in_one_text_and_repeated_rows(make):
    row = (7, "user=bob pwd=hunter2\n" * 500, "en", "s")
    rows = credentials.findings(make([row, row, (None, None, None, None)])).collect()
    assert sorted(len(r["spans"]) for r in rows) == [0, 1000, 1000]


def test_mixing_targets(spark):
    rng = random.Random(8)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 50, 400, 1000, 9000]) for s in ["a", "b", "c", "d", "Z", "é", None][: rng.randint(1, 7)]}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute.targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in got), (sizes, got, want)


def test_mixing_takes_near_targets_and_reruns_agree(make):
    rows = [(i, "w " * (i % 17), "en", [None, "a", "b", "hot"][min(3, i % 9)]) for i in range(6000)]
    df = make(rows)
    got = mixing.rates(df).collect()
    assert len(got) == 6000 and sorted(map(str, got)) == sorted(map(str, mixing.rates(df).collect()))
    for source in (None, "a", "b", "hot"):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) < 0.1 * own[0]["target"] and all(r["copies"] <= 2 for r in own)
    copies = {r["doc_id"]: r["copies"] for r in got}
    out = mixing.repeated(df)
    assert out.columns == df.columns and out.count() == sum(copies.values())
    assert mixing.rates(make([])).count() == 0 and mixing.repeated(make([])).count() == 0
    assert [r["copies"] for r in mixing.rates(make([None, ""])).collect()] == [0, 0]


def test_mixing_by_shuffle_is_the_same(make, monkeypatch):
    df = make([(i, "w " * (i % 17), "en", [None, "a", "b", "hot"][min(3, i % 9)]) for i in range(500)])
    want = sorted(map(str, mixing.rates(df).collect()))
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(map(str, mixing.rates(df).collect())) == want


def test_line_dedup_both_ways(make):
    hot = "  Same LINE \t"
    rows = [f"own {i}\n{hot if i % 2 else 'same line'}\nown {i}\n\nnine {i % 20}" for i in range(60)] + [None, "", "same line", hot]
    want = brute.line_dedup(dict(enumerate(rows)))
    got = {r["doc_id"]: r for r in linededup.deduplicated(make(rows)).collect()}
    for i, (n, dropped, kept) in want.items():
        r = got[i]
        assert (r["n_lines"], r["n_lines"] - sum(k["len"] for k in r["keep"]), r["kept_text"]) == (n, dropped, kept)
    first = {r["doc_id"]: r["kept_text"] for r in linededup.deduplicated(make(rows), keep_first=True).collect()}
    assert first[0] == rows[0] and first[1] == "own 1\nown 1\n\nnine 1" and first[63] == ""


def test_line_dedup_of_repeated_rows_and_empty_tables(make):
    assert linededup.deduplicated(make([])).count() == 0
    rows = [(5, "a\nb\na", "en", "s")] * 3 + [(None, "a", None, None)] * 2
    assert sorted(r["kept_text"] for r in linededup.deduplicated(make(rows), min_docs=2).collect()) == ["", "", "b", "b", "b"]
    assert sorted(r["kept_text"] for r in linededup.deduplicated(make(rows), min_docs=3).collect()) == ["a", "a", "a\nb\na", "a\nb\na", "a\nb\na"]

"""Samples, splits, tokens, mixes and template residue: brute force, exact round trips, held-out accuracy, empty and dirty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotline.llm.group_split import assign_splits, components, group_split, must_share, place_components, split_report
from slotline.llm.mail_text import own_text
from slotline.llm.mixing import SourceMix, _tokens_of
from slotline.llm.proportional_sample import ProportionalSample, seats
from slotline.llm.template_residue import ResidueDetector, clean_corpus, mask, segments
from slotline.llm.tokens import encoder


def naive_seats(available, share, floor, size):
    given = {c: min(n, floor.get(c, 0)) for c, n in available.items()}
    queue = sorted(((k - 0.5) / share[c], str(c), c) for c in available if share.get(c, 0) > 0 for k in range(given[c] + 1, available[c] + 1))
    for _, _, c in queue[: max(0, size - sum(given.values()))]:
        given[c] += 1
    return given


def test_seats_are_the_smallest_priorities():
    r = random.Random(1)
    for _ in range(200):
        names = "abcdef"[: r.randint(1, 6)]
        available = {c: r.choice([0, 3, 50, 400]) for c in names}
        share, floor = {c: r.choice([0.0, 0.1, 0.2, 0.35]) for c in names}, {c: r.choice([0, 5]) for c in names}
        size = r.randint(0, 300)
        assert seats(available, share, floor, size) == naive_seats(available, share, floor, size)


def test_sample(spark):
    rows = [("hot", i) for i in range(600)] + [("b", i) for i in range(40)] + [(None, i) for i in range(7)]
    df = spark.createDataFrame(rows, "c string, rank int").repartition(5)
    targets = spark.createDataFrame([("hot", 0.5, 5), ("b", 0.5, 5), ("none", 0.1, 3)], "c string, target_share double, min_rows bigint")
    s = ProportionalSample(df, targets, "c", ["c", "rank"], 100.7)
    assert {r.c: (r.available, r.sampled, r.reachable) for r in s.report().collect()} == {"hot": (600, 60, True), "b": (40, 40, False), "none": (0, 0, False)}
    got = s.rows().collect()
    assert len(got) == len(set((r.c, r.rank) for r in got)) == 100 and max(r.sample_rank for r in got if r.c == "hot") == 60
    empty = ProportionalSample(df.limit(0), targets, "c", ["c", "rank"], 0)
    assert empty.rows().count() == 0 and empty.report().count() == 3


def test_components_against_brute_force(spark):
    r = random.Random(2)
    links = [(f"n{r.randint(0, 60)}", f"n{r.randint(0, 60)}") for _ in range(45)] + [("hub", f"x{i}") for i in range(50)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("me", "me"), (None, "q"), ("hub", "x1")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a and b:
            root[find(b)] = find(a)
    want = {}
    for x in list(root):
        want.setdefault(find(x), []).append(x)
    got = {}
    for row in components(spark.createDataFrame(links, "a string, b string")).collect():
        got.setdefault(row.component, []).append(row.node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(v) for k, v in got.items())
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_splits(spark):
    records = spark.createDataFrame([("s", " a", 1), ("s", "A", 2), ("t", "a", 3), ("t", "b", 4), (None, None, 5)] + [("u", f"p{i}", 0) for i in range(400)], "source_file string, id string, component int")
    links = spark.createDataFrame([("s", "a ", "v", "gone"), ("v", "GONE", "t", "B"), ("s", "a", "s", "A")], "source_file_a string, id_a string, source_file_b string, id_b string")
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split_name string, target_share double")
    people = group_split(records, links, targets)
    assert {(r.participant_a, r.participant_b) for r in must_share(people).collect()} == {("s|A", "t|B")}
    by = {r.participant: r.split for r in people.collect()}
    assert by["s|A"] == by["t|B"] and len(by) == 404
    assert abs(sum(s == "train" for s in by.values()) / 404 - 0.8) < 0.08
    out = assign_splits(records.withColumnRenamed("component", "v"), links, targets)
    assert out.count() == records.count() and sum(r.n_rows for r in split_report(people, targets).collect()) == records.count()


def test_shares_of_rows_with_large_components(spark):
    r = random.Random(6)
    sizes = [("big", 3000), ("large", 900)] + [(f"c{i}", r.randint(1, 40)) for i in range(300)]
    total = sum(n for _, n in sizes)
    df = spark.createDataFrame(sizes, "component string, n_rows bigint").repartition(5)
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1), ("none", 0.0), (None, 0.5)], "split_name string, target_share double")
    placed = {x.component: x.split for x in place_components(df, targets).collect()}
    assert placed.keys() == {c for c, _ in sizes}
    got = {s: sum(n for c, n in sizes if placed[c] == s) / total for s in ("train", "val", "test", "none")}
    assert got == pytest.approx({"train": 0.8, "val": 0.1, "test": 0.1, "none": 0.0}, abs=1 / 256)
    one = place_components(df.filter("component = 'big'"), targets).collect()
    assert [(x.component, x.split) for x in one] == [("big", "train")] and place_components(df.limit(0), targets).count() == 0
    with pytest.raises(ValueError):
        place_components(df, targets.limit(0))


TEXTS = ["", None, " ", "Hello world", "don't they'll  \n\n x", "ñandú 日本語 🇪🇺👩‍🔬   z", "<|endoftext|>", "a" * 700 + " " * 300 + "=" * 600, "0123456789" * 40, "QmFzZTY0IGlzIGZ1bg==\r\n", "Hello world"]


def test_tokens_are_the_librarys(spark):
    tokenizers = pytest.importorskip("tokenizers")
    e = encoder(spark)
    reference = tokenizers.Tokenizer.from_file(e.path)
    reference.encode_special_tokens = True
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("abXY09+/ .,-\n'é語\t") for _ in range(r.randint(1, 900))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, words string").repartition(3)
    coded = e.encode(df)
    assert set(coded.columns) == {"doc_id", "text", "words", "ids"}
    for row in coded.collect():
        assert row.ids == reference.encode(row.text or "", add_special_tokens=False).ids, row.text
    back = e.decode(coded, text="again").collect()
    assert all(row.again == (row.text or "") for row in back)
    assert e.encode(df.limit(0)).count() == 0


def test_long_words_and_learnt_tables_give_the_librarys_ids(spark):
    tokenizers = pytest.importorskip("tokenizers")
    e = encoder(spark)
    reference = tokenizers.Tokenizer.from_file(e.path)
    reference.encode_special_tokens = True
    r = random.Random(5)
    texts = ["x" + "a" * 3001, "abc" * 900, "".join(r.choice("abcdeinorst") for _ in range(3000)), "é" * 400 + "日本語" * 200, "-" * 2000, "q" + " " * 1003 + "y", "a" * 256, "a" * 257]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    for code in (e, e.learnt(df, most_texts=4)):
        assert all(row.ids == reference.encode(row.text, add_special_tokens=False).ids for row in code.encode(df).collect())


def test_cuts_are_where_no_token_crosses(spark):
    e = encoder(spark)
    assert spark.createDataFrame([("QmFzZTYéK",)], "w string").select(F.array_join(e._crossable(F.col("w")), "").alias("j")).first().j == "QmFzZTYéK".encode().decode("latin-1")
    together = {(a, b) for t in e.vocabulary.tokens for a, b in zip(t, t[1:], strict=False)}
    for (a, b), _ in e.vocabulary.merges.items():
        assert (e.vocabulary.tokens[a][-1], e.vocabulary.tokens[b][0]) in together


def test_mix_meets_reachable_targets(spark):
    r = random.Random(4)
    words = {"a": "pump sensor", "b": "visit letter", "c": "kit box"}
    docs = [(i, None if i % 50 == 0 else " ".join(r.choice(words[s].split()) for _ in range(r.randint(5, 60))), s) for i, s in enumerate(r.choices("abc", [8, 3, 1], k=600))]
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 3), ("c", 0.3, 2), ("gone", 0.0, 1)], "source string, target_share double, max_repeats bigint")
    mix = SourceMix(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), targets)
    report = {x.source: x for x in mix.report().collect()}
    assert not report["c"].reachable and report["a"].reachable and report["b"].reachable and report["gone"].tokens == 0
    assert report["c"].mixed_tokens == 2 * report["c"].tokens and report["c"].lacking_tokens == pytest.approx(report["c"].wanted_tokens - 2 * report["c"].tokens)
    total = mix.total - sum(x.lacking_tokens for x in report.values())
    assert sum(x.rated_tokens for x in report.values()) == pytest.approx(total, rel=1e-6)  # the corpus less what is lacking
    right, commonest, n = mix.membership.held_out
    assert mix.membership.weight > 0 and right > 0.95 > commonest and n > 100  # the tokens tell the domain here
    of_text = mix.membership.of(np.array(encoder(spark).encode(spark.createDataFrame([("visit letter visit",)], "text string")).first().ids), -1)
    assert mix.sources[int(np.argmax(of_text))] == "b"
    assert all(x.expected_tokens == pytest.approx(x.rated_tokens, rel=0.05, abs=0.02 * mix.total) for x in report.values())
    caps = {"a": 1, "b": 3, "c": 2}
    rows = mix.rows().collect()
    for name in "ab":  # the rates meet the target; whole repeats do within the noise of rounding
        own = [x for x in rows if x.source == name]
        assert sum(x.n_tokens * x.rate for x in own) == pytest.approx(report[name].wanted_tokens, rel=0.01)
        noise = sum((x.n_tokens * 0.5) ** 2 for x in own) ** 0.5
        assert abs(report[name].mixed_tokens - report[name].wanted_tokens) < 4 * noise
    assert len(rows) == 600 and all(0 <= x.copies <= caps[x.source] for x in rows)


def test_mix_of_nothing(spark):
    documents, targets = spark.createDataFrame([(1, "a b", "x"), (2, None, None)], "doc_id bigint, text string, source string"), spark.createDataFrame([("x", 0.5, 2), ("y", 0.1, None)], "source string, target_share double, max_repeats bigint")
    assert SourceMix(documents, targets.limit(0)).report().count() == 0
    none = SourceMix(documents.limit(0), targets)
    assert none.rows().count() == 0 and [r.tokens for r in none.report().collect()] == [0, 0]
    one = {r.source: r.reachable for r in SourceMix(documents, targets).sources_table().collect()}
    assert one == {"x": True, "y": False}


MAIL = "From: A <a@x.test>\nSubject: s\nMIME-Version: 1.0\nContent-Type: {}\nContent-Transfer-Encoding: {}\n\n{}"


def test_tokens_of_sources_among_very_many(spark):
    members = spark.range(250_000).selectExpr("concat('s', id) as source", "id + 1 as n_tokens")
    assert _tokens_of(members, [f"s{k}" for k in range(0, 250_000, 5000)] + ["none"]).tolist() == [k + 1.0 for k in range(0, 250_000, 5000)] + [0.0]


def test_own_text():
    assert own_text(None).lines == own_text("").lines == own_text(" \n").lines == []
    assert own_text(MAIL.format("text/plain", "base64", "SGVsbG8K\nPiBxdW90ZWQK")).lines == ["Hello"]
    assert own_text(MAIL.format("text/plain; charset=utf-8", "quoted-printable", "caf=C3=A9 =\nbar\nOn 1 May, B <b@x.test> wrote:\n> no\n-- \nme")).lines == ["café bar"]
    both = MAIL.format('multipart/mixed; boundary="B"', "7bit", "--B\nContent-Type: text/html\n\n<p>shown</p><!-- {{hidden}} --><div style='display:none'>{{x}}</div><pre>{{code}}</pre>\n--B\nContent-Type: text/plain; name=\"f.txt\"\n\nattached")
    assert own_text(both).lines == ["shown"]  # the last boundary is missing, too
    assert own_text(MAIL.replace("\n", "\r\n").format("text/plain", "8bit", "eins\r\nzwei")).lines == ["eins", "zwei"]


def test_segments_are_whole():
    long = MAIL.format("text/plain", "7bit", "word " * 50_000 + "{{ name }} end.")
    assert "phtok" in mask(segments(long)[-1])


def test_marks_do_not_depend_on_the_order_of_mails(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "sender")
    d = ResidueDetector.fit(documents)
    pair = [(90001, MAIL.format("text/plain", "7bit", "Error 404"), "a@x.test"), (90002, MAIL.format("text/plain", "7bit", "Error 204"), "a@x.test")]
    both = documents.unionByName(spark.createDataFrame(pair, documents.schema))
    ways = [both.coalesce(1).orderBy("doc_id"), both.coalesce(1).orderBy(F.desc("doc_id")), both.repartition(9)]
    first, *others = [{r.doc_id: (r.marked, r.kind, r.score) for r in d.mark(w).collect()} for w in ways]
    assert all(first == o for o in others)
    parts = segments(MAIL.format("text/plain", "7bit", "Error 404 \n Error 204"))
    assert d.kind_of(parts, {}) == d.kind_of(parts[::-1], {})


def test_residue_on_unseen_hosts(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "sender", F.lit("x").alias("kind"))
    d = ResidueDetector.fit(docs)
    assert {name: precision > 0.8 and recall > 0.8 for name, _, _, precision, recall in d.report} == {"residue": True, "content": True, "junk": True}
    cases = [
        (1, MAIL.format("text/plain", "7bit", "Dear {{ first_name }}, your visit is planned for [[date]] at our Oststrand office.\n\nThanks,\nA"), True),
        (2, MAIL.format("text/plain", "7bit", "404 Not Found"), True),
        (3, MAIL.format("text/plain", "7bit", "Please enable JavaScript to view this page."), True),
        (4, MAIL.format("text/plain", "7bit", "Hi both,\n\nTwo people asked how to enable JavaScript for the visit calendar: it's under Settings, Privacy, third switch. I have put the diary export for week 3 on the shared drive; it has 4 rows more than last time.\n\nCheers, A"), False),
        (5, MAIL.format("text/plain", "7bit", "Hi both,\n\nThe numbers in table 5 don't add up: 7 entries went in, but only 3 came out.\n\n> Dear {{ name }}, your visit"), False),
        (6, None, False), (7, "", False), (8, "   ", False), (2, MAIL.format("text/plain", "7bit", "404 Not Found"), True),
    ]
    df = spark.createDataFrame([(i, t, "a@x.test") for i, t, _ in cases], "doc_id bigint, text string, sender string")
    marks = d.mark(df)
    assert sorted((r.doc_id, r.marked) for r in marks.collect()) == sorted((i, m) for i, _, m in cases)
    assert sorted(r.doc_id for r in clean_corpus(df, marks).collect()) == [4, 5, 6, 7, 8]
    empty = ResidueDetector.fit(df.limit(0))
    assert empty.mark(df.limit(0)).count() == 0

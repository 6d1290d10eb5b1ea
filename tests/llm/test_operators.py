import collections
import hashlib
import random
import time
import zlib

import brute
import compare
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF

import corpus_pipeline
from trawlspark.llm import bpe, chat_format, common, components, decontaminate, line_dedup, minhash_dedup, oracles, pii, quality_model, quality_rules, substring_dedup, toxicity
from trawlspark.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(2000)]
LONG = " ".join(R.choice(VOCABULARY) for _ in range(60_000))


def prose(n: int) -> list[str]:
    return [R.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="module")
def real():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"]) for r in t]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Nulls in every column, no text, one word, ties, repeated rows, one very long text, characters outside ASCII.
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, "one", None, "a", 3), (None, "no id at all", "en", "a", 1), (None, None, None, None, None), (5, "same text here", "en", "a", 1), (5, "same text here", "en", "a", 1), (6, "same text here", "en", "b", 1), (7, LONG, "en", "b", 1), (8, "ñ 日本 😀😀 É é\n\nÉ é", "x", "c", 1)]


def odd(spark):
    """The odd rows with columns whose names the operators use themselves."""
    d = spark.createDataFrame(ODD, SCHEMA)
    for name in ("kept", "band", "key", "row", "n_removed", "n_found", "drop", "id", "ids", "words", "h1", "component_id", "score"):
        d = d.selectExpr("*", f"'extra' AS `{name}`")
    return d


def run_all(spark, docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "same text here"), (2, None), (None, ""), (3, LONG[:900])], "item_id long, text string")
    return {
        "near": minhash_dedup.near_duplicates(docs), "toxicity": toxicity.toxicity(docs, labels), "pii": pii.pseudonymize(docs), "lines": line_dedup.dedup_lines(docs), "quality": quality_rules.quality_rules(docs),
        "repeats": substring_dedup.remove_repeats(docs), "leaks": decontaminate.decontaminate(docs, items), "bpe": bpe.digests(bpe.round_trip(docs, tokenizer_path())), "grades": quality_model.grade_documents(docs, labels),
    }


def test_odd_rows_have_defined_results(spark, tmp_path):
    docs = odd(spark)
    out = {k: [r.asDict() for r in v.collect()] for k, v in run_all(spark, docs, tmp_path).items()}
    assert {k: len(v) for k, v in out.items()} == dict.fromkeys(out, len(ODD))
    near = collections.defaultdict(set)
    for r in out["near"]:
        near[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert near[1] == {(0, 1, True)} and near[5] == {(1, 5, True)} and near[6] == {(1, 5, False)}
    repeats = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in out["repeats"]}
    assert repeats[7] == (60_000, 0) and repeats[1] == (0, 0)
    assert {r["doc_id"] for r in out["leaks"] if not r["kept"]} == {5, 6, 7}
    assert {r["n_words"] for r in out["quality"] if r["doc_id"] in (1, 2, 3)} == {0} and not any(r["kept"] for r in out["quality"] if r["doc_id"] == 1)
    assert {r["text"] for r in out["pii"] if r["doc_id"] == 1} == {None} and {r["text"] for r in out["lines"] if r["doc_id"] == 3} == {" \n\t "}
    assert {r["n_tokens"] for r in out["bpe"] if r["doc_id"] in (1, 2)} == {0}
    assert all(0 <= r["score"] <= 1 for r in out["toxicity"])


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    for name, df in run_all(spark, none, tmp_path).items():
        assert df.count() == 0, name
    assert decontaminate.decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert chat_format.digests(chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# ---- near duplicates ------------------------------------------------------------------------------


def check_near(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(docs)


def test_near_duplicates_of_real_documents(spark, real):
    check_near(spark, real)


def test_near_duplicates_around_the_threshold(spark):
    """One group whose pairs lie on both sides of 0.75: leaders join most of it, blocks the rest."""
    base, docs = prose(120), []
    for i in range(700):
        w = list(base)
        for _ in range(R.choice((1, 2, 3, 4, 5, 6))):
            w[R.randrange(len(w))] = R.choice(VOCABULARY)
        docs.append((3 * i, " ".join(w)))
    line = " ".join(VOCABULARY[:9])
    docs += [(10_000 + i, line + "\n" + " ".join(prose(6))) for i in range(100)]
    check_near(spark, docs)


def test_min_max_is_unbiased():
    a, b = np.arange(1, 2001, dtype=np.uint64), np.arange(501, 2501, dtype=np.uint64)
    from trawlspark.llm import arrowtext as T

    both = minhash_dedup.min_max(T.mix(np.concatenate([a, b])), np.array([0, 2000, 4000]))
    assert both.shape == (2, 128) and abs((both[0] == both[1]).mean() - 0.6) < 0.15


def test_short_pairs_at_the_threshold_share_a_band():
    """Sets of 3 of 4 shingles: by 32 bands alone about one pair in 10,000 shares none."""
    full = [" ".join(f"{i}x{k}" for k in range(8)) for i in range(60_000)]
    texts = full + [t.rsplit(" ", 1)[0] for t in full]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    found = pa.Table.from_batches(minhash_dedup._signatures(iter([batch])))
    a = np.stack(found.column("bands").to_numpy())
    assert found.column("n_shingles").to_pylist() == [4] * 60_000 + [3] * 60_000
    assert (a[:60_000] == a[60_000:]).any(axis=1).all()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10_000)] + [(20_000, 19_999), (7, 7)], "a long, b long")
    began = time.time()
    assert {tuple(r) for r in components.components(edges).collect()} == {(i, 0) for i in range(10_001)} | {(19_999, 19_999), (20_000, 19_999)}
    assert time.time() - began < 60  # about 15 s alone; rounds in proportion to the chain would take minutes


def test_components_of_random_graphs(spark):
    r = random.Random(11)
    for n, m in ((300, 200), (500, 420), (200, 600)):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(n + 5, n + 6)] + [(1000, 1000 + k) for k in range(1, 40)]
        top = {}

        def find(x):
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        for a, b in pairs:
            if a != b:
                u, v = find(a), find(b)
                top[max(u, v)] = min(u, v)
        assert {tuple(x) for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == {(x, find(x)) for x in list(top)}


def thue_morse(n: int, letters: str) -> str:
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


#: Two words on which any polynomial modulo 2**64 collides.
TWINS = [(thue_morse(n, "ab"), thue_morse(n, "ba")) for n in (1024, 2048)]


def test_words_that_polynomials_confuse(spark):
    from tokenizers import Tokenizer

    for a, b in TWINS:
        head = prose(34)
        docs = [(1, f"{a} one two three four"), (2, f"{b} one two three four"), (3, " ".join([a, *head])), (4, " ".join([b, *head])), (5, a), (6, b), (7, f"x {a} y {b}")]
        check_near(spark, docs)
        check_repeats(spark, docs)
        items = [(1, f"{a} one two three four"), (2, b)]
        rows = spark.createDataFrame(docs, "doc_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
        assert got == brute.contaminated(docs, items) and (2, 1) not in got
        t = Tokenizer.from_file(tokenizer_path())
        for r in bpe.decode(bpe.encode(rows, tokenizer_path()), tokenizer_path()).collect():
            ids = t.encode(dict(docs)[r["doc_id"]], add_special_tokens=False).ids
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r["text"] == dict(docs)[r["doc_id"]]


def test_windows_by_halves_are_told_apart():
    """Windows of all lengths over two words, in the patterns that cancel out in sums of powers."""
    from trawlspark.llm import arrowtext as T

    words = thue_morse(4096, "ab")
    column = pa.array([" ".join(words)])
    lanes = T.split_words(column).digests()
    for lane in (0, 1):
        w = T.Windows(lanes[lane], lane)
        for n in (1, 2, 5, 14, 15, 35, 64, 1024):
            starts = np.arange(4096 - n + 1)
            seen = {}
            for h, k in zip(w(starts, n).tolist(), starts.tolist(), strict=True):
                assert seen.setdefault(h, words[k : k + n]) == words[k : k + n]
            assert len(seen) == len({words[k : k + n] for k in starts.tolist()})


# ---- repeated passages ----------------------------------------------------------------------------


def test_cover_has_every_difference():
    c, p = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % p for a in c for b in c} == set(range(p))


def check_repeats(spark, docs):
    got = [tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).drop("kept_text").collect()]
    assert sorted(got) == sorted(brute.remove_repeats(docs))


def test_repeats_of_real_documents(spark, real):
    check_repeats(spark, real)


def test_repeats_at_every_offset_and_length(spark):
    passage, docs = prose(80), []
    for k in range(60):
        cut = passage[k % 7 : k % 7 + R.choice((34, 35, 36, 50))]
        docs.append((k, "\n".join([" ".join(prose(R.randrange(40))), " ".join(cut), " ".join(prose(R.randrange(40)))])))
    docs += [(100, " ".join(prose(10) * 9)), (101, " ".join(passage[:34])), (102, " ".join(passage)), (103, " ".join(passage))]
    check_repeats(spark, docs)


def test_places_travel_as_arrays():
    """A chunk sends a row for each part of its hashes, not one for each place; the places that come out are those of a plain count, over both lanes."""
    r = np.random.default_rng(5)
    chunks = [(r.integers(0, 4000, n).astype(np.uint64) << np.uint64(52), r.integers(0, 2, n).astype(np.uint64), r.integers(0, 50, n), r.integers(0, 90, n)) for n in (1, 700, 3000, 5000)]
    parts = np.arange(100, 116, dtype=np.int32)
    for lanes in (1, 2):
        rows = [b for h, o, key, at in chunks for b in substring_dedup._places(parts, h, o if lanes == 2 else None, key, at)]
        sent = pa.Table.from_batches(rows).sort_by("part")
        assert sent.num_rows <= 4 * 2 * 16
        names = [x for h, o, _, _ in chunks for x in (zip(h.tolist(), o.tolist(), strict=True) if lanes == 2 else h.tolist())]
        places = [x for _, _, key, at in chunks for x in zip(key.tolist(), at.tolist(), strict=True)]
        count = collections.Counter(names)
        found = list(substring_dedup._repeated(iter(sent.to_batches(7)), parts))
        assert sum(b.num_rows for b in found) <= 16
        documents = [row for b in substring_dedup._by_document(iter(found)) for row in b.to_pylist()]
        assert len({row["key"] for row in documents}) == len(documents)
        got = [(row["key"], a) for row in documents for a in row["ats"]]
        assert sorted(got) == sorted(p for p, x in zip(places, names, strict=True) if count[x] > 1)


def test_repeats_of_one_large_hash():
    high = np.full(3, 2**64 - 1, np.uint64)
    rows = list(substring_dedup._places(np.arange(16, dtype=np.int32), high, None, np.arange(3), np.arange(3)))
    assert sum(b.num_rows for b in rows) == 2


# ---- quality rules and lines ----------------------------------------------------------------------


def test_base_counts(spark, real):
    extra = [(-1, "a b c d e f a b c d e g a b c d e"), (-2, "x " * 50), (-3, "l one\n\nl one\n \nl one "), (-4, "#*$%&|<> é")]
    docs = real + extra
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: brute.base_counts(t) for i, t in docs}


def test_cells_are_monotonic_and_close(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 20_000, 7).select("id", quality_rules.cell(F.col("id")).alias("c")).withColumn("low", quality_rules.cell_floor(F.col("c"))).orderBy("id").collect()
    assert all(a["c"] <= b["c"] for a, b in zip(rows, rows[1:], strict=False))
    assert all(r["low"] <= r["id"] <= r["low"] * (1 + 1 / quality_rules.CELLS) + 1 for r in rows)


def test_rules_reject_junk_and_keep_clean_documents(spark):
    rows = [(i, " ".join(prose(100)), "en", f"s{i % 3}") for i in range(600)]
    rows += [(1000 + i, " ".join(x + "###" for x in prose(100)), "en", "s0") for i in range(30)] + [(2000 + i, "WORD!! LOUD!! " + " ".join(x.upper() + "!!" for x in prose(60)), "en", "s1") for i in range(30)]
    kept = {r["doc_id"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).filter("kept").collect()}
    assert kept == set(range(600))


def test_lines_near_the_threshold(spark):
    rows = [(s * 10 + k, f"s{s}", "\n".join([f"unique {s} {k}", *(f"line {n}" for n in range(5, 15) if s < n)])) for s in range(14) for k in range(2)]
    rows += [(1000 + s, f"s{s}", "a copied document\nof two lines") for s in range(14)]
    gone = brute.boilerplate([(s, t) for _, s, t in rows], 10)
    assert gone == {f"line {n}" for n in range(10, 15)}
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {i: brute.without_lines(t, gone) for i, _, t in rows}


def test_rows_of_one_doc_id_keep_their_own_lines_and_words(spark):
    common = [(100 + k, f"s{k}", f"shared line\nown {k}") for k in range(12)]
    rows = [*common, (1, "a", "shared line\nmine"), (1, "b", "my own line\nother"), (None, "c", "shared line"), (None, "d", "keep me\nshared line")]
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()), key=repr)
    assert got == sorted([*((100 + k, f"own {k}") for k in range(12)), (1, "mine"), (1, "my own line\nother"), (None, ""), (None, "keep me")], key=repr)
    passage, mine = " ".join(prose(40)), " ".join(prose(50))
    docs = [(1, f"{passage} tail"), (1, mine), (2, f"start {passage}"), (None, passage), (None, "short")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 41, 40), (1, 50, 0), (2, 41, 40), (None, 40, 40), (None, 1, 0)], key=repr)


def test_many_boilerplate_lines_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    rows = [(k, f"s{k}", f"shared line\nown {k}\nother shared") for k in range(14)]
    assert {r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()} == {f"own {k}" for k in range(14)}


# ---- personal data --------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pseudonyms_keep_their_format(spark):
    from pyspark.sql import functions as F

    cards = [c for c in (f"4{i:014d}" for i in range(300, 700)) for c in [c + k for k in "0123456789"] if luhn(c)]
    values = [*cards, "4111 1111 1111 1111", "4111111111111112", "+1 (578) 555-6437", "+49 30 1234567", "2024-02-29", "2023-02-29", "31.12.1999", "12/31/1999", "10.0.255.3", "10.0.256.3", "123-45-6789", "ab.c@x.example.com", "0" * 20 + "a" * 20, "F" * 20 + "0" * 20, "12345"]
    got = dict(tuple(r) for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.pseudonym(F.col("v"))).collect())
    news = [got[c] for c in cards]
    assert all(luhn(x) and len(x) == 16 for x in news) and len(set(news)) == len(cards) and sum(a == b for a, b in zip(cards, news, strict=True)) < 3
    for v in ("4111111111111112", "2023-02-29", "10.0.256.3", "12345"):
        assert got[v] == v
    shape = lambda x: "".join("9" if c.isdigit() else c for c in x)
    for v in ("4111 1111 1111 1111", "+1 (578) 555-6437", "+49 30 1234567", "2024-02-29", "31.12.1999", "12/31/1999", "123-45-6789"):
        assert got[v] != v and shape(got[v]) == shape(v)
    assert got["+49 30 1234567"].startswith("+49 ") and all(int(x) < 256 for x in got["10.0.255.3"].split("."))
    assert set(got["F" * 20 + "0" * 20]) <= set("0123456789ABCDEF") and got["ab.c@x.example.com"].endswith("@mail.invalid")


def feistel(text: str, alphabet: str, key: str) -> str:
    half = len(text) // 2
    a, b = text[:half], text[half:]
    for r in range(1, pii.ROUNDS + 1):
        h = hashlib.sha256(f"{key}|{len(alphabet)}|{r}|{len(a)}|{b}".encode()).hexdigest()
        a, b = b, "".join(alphabet[(alphabet.index(c) + int(h[2 * k : 2 * k + 2], 16)) % len(alphabet)] for k, c in enumerate(a))
    return a + b


def put(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def brute_pseudonym(kind: str, v: str, key: str = pii.KEY) -> str:
    d = "".join(c for c in v if c.isdigit())
    if kind == "card":
        body = feistel(d[:-1], pii.DIGITS, key)
        return put(v, next(body + k for k in "0123456789" if luhn(body + k)))
    if kind == "phone":
        n = 1 if d[0] in "17" else 2 if d[:2] in "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split() else 3
        return put(v, d[:n] + feistel(d[n:], pii.DIGITS, key))
    if kind == "ssn":
        return put(v, feistel(d, pii.DIGITS, key))
    if kind == "ip":
        h = feistel("".join(f"{int(x):02x}" for x in v.split(".")), pii.HEX, key)
        width = 3 if any(len(x) > 1 and x[0] == "0" for x in v.split(".")) else 0
        return ".".join(str(int(h[k : k + 2], 16)).zfill(width) for k in (0, 2, 4, 6))
    import datetime

    forms = {"-": ("%Y-%m-%d",), ".": ("%d.%m.%Y",), "/": ("%m/%d/%Y", "%d/%m/%Y")}[next(c for c in v if not c.isdigit())]
    for form in forms:
        try:
            day = datetime.datetime.strptime(v, form).date()
        except ValueError:
            continue
        start = datetime.date(1900, 1, 1)
        n = (day - start).days
        block = n // 100_000 * 100_000
        new = start + datetime.timedelta(days=block + int(feistel(f"{n - block:05d}", pii.DIGITS, key)))
        return form.replace("%Y", f"{new.year:04d}").replace("%m", f"{new.month:02d}").replace("%d", f"{new.day:02d}")
    return v


def test_pseudonyms_are_those_of_plain_python(spark):
    from pyspark.sql import functions as F

    r = random.Random(9)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    values = [("card", b + k) for b in (r.choice("3456") + number(r.choice((14, 15))) for _ in range(60)) for k in "0123456789" if luhn(b + k)]
    values += [("ip", ".".join(str(r.randrange(256)) for _ in range(4))) for _ in range(60)] + [("ip", "192.168.001.010"), ("ssn", "123-45-6789"), ("ssn", "987-65-4321")]
    values += [("phone", x) for x in ("+49301234567", "+49 30 1234567", "+4930 123 4567", "+1 (578) 555-6437", "+15785556437", "+44 20 7946 0958", "+351 912 345 678", "+7 495 123 4567", "+86 138 0013 2024")]
    values += [("date", x) for x in ("1999-12-31", "31.12.1999", "12/31/1999", "31/12/1999", "1815-06-18", "2400-02-29", "0033-04-03", "2023-02-29", "05/06/2001")]
    got = {x["v"]: x["p"] for x in spark.createDataFrame(values, "kind string, v string").select("v", pii.pseudonym(F.col("v")).alias("p")).collect()}
    assert got == {v: brute_pseudonym(kind, v) for kind, v in values}
    digits = lambda v: "".join(c for c in got[v] if c.isdigit())
    assert digits("+49301234567") == digits("+49 30 1234567") == digits("+4930 123 4567") and got["+49301234567"].startswith("+49") and digits("+1 (578) 555-6437") == digits("+15785556437")
    assert all(got[v] != v for v in ("31/12/1999", "1815-06-18", "0033-04-03")) and got["2023-02-29"] == "2023-02-29"


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1000).select(pii.feistel(F.lpad(F.col("id").cast("string"), 3, "0"), pii.DIGITS, "k").alias("p"))
    assert rows.distinct().count() == 1000


def test_equal_values_stay_linked_and_the_rest_stays(spark):
    rows = [(1, "call +1 (578) 555-6437, or a.b@c.org.\nend"), (2, "+1 (578) 555-6437"), (3, "no 4111111111111112 card, v1.2.3, 12:30"), (4, None)]
    got = {r["doc_id"]: (r["text"], r["n_found"]) for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][1] == 2 and got[2][0] in got[1][0] and got[1][0].endswith(".\nend") and "555-6437" not in got[1][0]
    assert got[3] == (rows[2][1], 0) and got[4] == (None, 0)


def test_digits_beside_a_number_hide_nothing(spark):
    phone, other, ip, card, spaced, date = "+1 (826) 555-4081", "+44 20 7946 0958", "190.137.223.204", "4111111111111111", "4111 1111 1111 1111", "2024-05-12"
    # Each text and the values in it; all else stays.
    texts = {
        f"{phone} {ip} du": [phone, ip], f"{other} {ip}": [other, ip], f"{phone} 2024 x": [phone], f"{other} 2024": [other], f"{phone} {date}": [phone, date], f"+49 30 12345678 {date}": ["+49 30 12345678", date],
        f"{phone} {spaced}": [phone, spaced], f"{phone} 190.1": [phone], "+49 30 12345678 12@example.com": ["+49 30 12345678", "12@example.com"], "+86 138 0013 2024": ["+86 138 0013 2024"], "+49 30 123.45.67": ["+49 30 123.45.67"],
        f"pay {card} 12 items": [card], f"pay 12 {card}": [card], f"{card} 12/27": [card], f"{spaced} 12 items": [spaced], f"2024 {spaced} 12": [spaced], f"{card} {ip}": [card, ip], f"{card} {spaced}": [card, spaced],
        f"12 {card} 5-12abc": [card], f"{card} 123-45-6789": [card, "123-45-6789"], "4111-1111-1111-1111": ["4111-1111-1111-1111"], "41111111 11111111 12": ["41111111 11111111"], " ".join(card) + " 12": [" ".join(card)],
        "5-1.2.3.4": ["1.2.3.4"], "12 4111111111111112 34": [], " ".join(str(k) for k in range(5, 40)) + f" {card}": [card],
    }
    alone = sorted({v for vs in texts.values() for v in vs})
    one = {r["text"]: r["new"] for r in pii.pseudonymize(spark.createDataFrame([(v, v) for v in alone], "v string, text string")).selectExpr("v AS text", "text AS new").collect()}
    assert all(one[v] != v for v in alone)
    got = {r["v"]: (r["text"], r["n_found"]) for r in pii.pseudonymize(spark.createDataFrame([(t, t) for t in texts], "v string, text string")).collect()}
    want = {}
    for t, vs in texts.items():
        want[t] = t, len(vs)
        for v in vs:
            want[t] = want[t][0].replace(v, one[v], 1), len(vs)
    assert got == want
    long = " ".join(["12345"] * 3000) + f" {card} 7"
    assert pii.pseudonymize(spark.createDataFrame([(long,)], "text string")).collect()[0]["text"].endswith(f" 12345 {one[card]} 7")


# ---- chat -----------------------------------------------------------------------------------------

SPELLS = ["<|im_end|>", "<|im_start|>", "<|im_start|~|>", "~l", "~t", "~", "<", "\n", "a", "<|im_end|>\n<|im_start|>user\n", "é"]


def test_chat_round_trip(spark):
    rows = [(c, t, R.choice(["user", "assistant", "sys\ntem", "<|im_end|>"]), "".join(R.choice(SPELLS) for _ in range(R.randrange(6)))) for c in range(200) for t in range(R.randrange(1, 4))]
    rows += [(900, 0, None, None), (900, 0, None, None), (None, None, "assistant", "x")]
    got = {r["conv_id"]: r for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, r, x in sorted(turns, key=lambda t: (t[0] is not None, t))]
    assert not got[900]["escaped"]


def test_chat_digests(spark):
    got = {r["conv_id"]: r for r in QUERIES["op7_chat_format"](spark, SF).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    assert got[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and (got[-1]["n_turns"], got[-1]["loss_chars"]) == (2, len(said))


# ---- benchmark ------------------------------------------------------------------------------------


def test_loss_spans_cut_the_assistant_texts(spark):
    rows = [(c, t, R.choice(("user", "assistant", "assistant\n", "assistant x")), "".join(R.choice(SPELLS + ["😀"]) for _ in range(R.randrange(6)))) for c in range(200) for t in range(R.randrange(1, 5))]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    undo = lambda s: s.replace("~n", "\n").replace("~l", "<").replace("~t", "~")
    for r in out:
        cut = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert [undo(x) if s["escaped"] else x for x, s in zip(cut, r["loss_spans"], strict=True)] == [t for c, _, role, t in rows if c == r["conv_id"] and role == "assistant"]
    assert any(s["escaped"] for r in out for s in r["loss_spans"]) and any(not s["escaped"] and s["length"] for r in out for s in r["loss_spans"])


def test_decontamination(spark, real):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    items += [(900, "four words only here"), (901, None), (902, "AB cd"), (903, " ".join(VOCABULARY[:30]))]
    docs = [*real, (-1, "so four words only here it is"), (-2, " ".join(VOCABULARY[3:30])), (-3, "ab CD"), (-4, " ".join([*prose(50), *VOCABULARY[:14], "other", *VOCABULARY[15:30]]))]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.contaminated(docs, items)


def test_blocks_find_all_within_the_radius():
    r = np.random.default_rng(3)
    index = decontaminate.Index(list(range(200)), [" ".join(f"i{k}x{j}" for j in range(20)) for k in range(200)])
    for bits in (0, 10, decontaminate.RADIUS, decontaminate.RADIUS + 1):
        flips = np.zeros((200, 64), bool)
        for row in flips:
            row[r.choice(64, bits, replace=False)] = True
        near = index.prints ^ decontaminate._packed(flips)
        found = {i: set(at.tolist()) for i, at in index.near(near, 20)}
        assert [k in found.get(k, ()) for k in range(200)] == [bits <= decontaminate.RADIUS] * 200


def test_blocks_select_few_unrelated_fingerprints():
    index = decontaminate.Index(list(range(64)), [" ".join(f"i{k}x{j}" for j in range(30)) for k in range(64)])
    prints = np.random.default_rng(5).integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2)
    parts = prints.view(np.uint16).reshape(-1, decontaminate.BLOCKS)
    looked_at = sum(int(np.bitwise_count(np.bitwise_or.reduce([index.table[b, g][parts[:, b]] for b in range(decontaminate.BLOCKS)])).sum()) for g in range(8))
    assert looked_at < 0.2 * 64 * 20_000 and sum(len(at) for _, at in index.near(prints, decontaminate.size_class(30))) < 0.003 * 64 * 20_000


@pytest.mark.parametrize("size", [15, 31, 59, 200])
def test_fingerprints_recall_similar_windows(size):
    """Windows of an item with words replaced until the similarity is between 0.75 and 0.8 or 0.8 and 0.9: what fingerprints alone find of them."""
    item = prose(size)
    index = decontaminate.Index([1], [" ".join(item)])
    rows = {0.75: [], 0.8: []}
    for _ in range(6000):
        w = list(item)
        for _ in range(R.choice((1, 1, 2, 3, 4, 6))):
            k = R.choice((0, size - 1, R.randrange(size), R.randrange(size)))
            w[k] = R.choice(VOCABULARY)
        a, b = brute._weighted(item), brute._weighted(w)
        both = sum(min(n, b.get(x, 0)) for x, n in a.items())
        like = both / (sum(a.values()) + sum(b.values()) - both)
        if 0.75 <= like < 0.9:
            rows[0.75 if like < 0.8 else 0.8].append(" ".join(w))
    for least, wanted in ((0.75, 0.97), (0.8, 0.99)):
        if rows[least]:
            doc = index.matches(pa.array(rows[least]))[0]
            assert len(set(doc.tolist())) >= wanted * len(rows[least]), (least, len(rows[least]))


def test_long_items_need_little_memory():
    import tracemalloc

    item = prose(20_000)
    tracemalloc.start()
    index = decontaminate.Index([1], [" ".join(item)])
    doc = index.matches(pa.array([" ".join(prose(30_000)), " ".join(prose(500) + item + prose(500))]))[0]
    assert tracemalloc.get_traced_memory()[1] < 200 << 20 and set(doc.tolist()) == {1}
    tracemalloc.stop()


# ---- tokens ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [bpe.CHUNK_BYTES, 2000])
def test_bpe_is_the_library(spark, real, chunk):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    docs = [*real[:60], (-1, None), (-2, ""), (-3, "a<|endoftext|> b  \n c's don'T"), (-4, "日本語 ñandú 😀😀  "), (-5, "x" * 3000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(rows, tokenizer_path(), chunk), tokenizer_path()).collect()}
    assert got == {r["doc_id"]: r for r in bpe.round_trip(rows, tokenizer_path(), chunk).collect()}
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == ids and got[i]["text"] == t.decode(ids, skip_special_tokens=False), i


def test_split_is_the_pre_tokenizer():
    from tokenizers import Tokenizer

    pre = Tokenizer.from_file(tokenizer_path()).pre_tokenizer
    parts = [" ", "  ", "\n", "'", "'s", "'re", "'ll", "r", "e", "l", "s", "É", "1", "٣", "!", "--", " ", "　", "\t", "😀", "'d", "́", "\x1c", "\x85"]
    cases = ["".join(R.choice(parts) for _ in range(R.randrange(14))) for _ in range(3000)]
    s = bpe.Split(pa.array(cases))
    for i, x in enumerate(cases):
        assert [s.text[a:b] for a, b in zip(s.starts[s.first[i] : s.first[i + 1]], s.ends[s.first[i] : s.first[i + 1]], strict=True)] == [x[a:b] for _, (a, b) in pre.pre_tokenize_str(x)], repr(x)


# ---- classifiers ----------------------------------------------------------------------------------


def labelled():
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pandas().merge(pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas(), on="doc_id")
    out = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in docs.doc_id])
    return docs[~out], docs[out]


def auc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].mean() - (y == 1).sum() / 2 + 0.5) / (y == 0).sum()


def test_toxicity_on_held_out_rows():
    seen, out = labelled()
    m = toxicity.train(pa.array(seen.text), seen.toxic.to_numpy(), np.ones(len(seen)))
    p = m.scores(*toxicity.word_buckets(pa.array(out.text)))
    y = out.toxic.to_numpy()
    assert auc(p, y) > 0.93 and ((p >= 0.5) == y).mean() > 0.96


def test_grades_on_held_out_rows():
    seen, out = labelled()
    grade = lambda d: np.where(d.quality == 0, 0, np.where(d.toxic == 1, 1, 2))
    m = quality_model.train(pa.array(seen.text), grade(seen), np.ones(len(seen)), 3)
    below = m.below(m.scores(*quality_model.features(pa.array(out.text))))
    assert (np.diff(m.cuts) > 0).all() and (np.diff(below, axis=1) >= 0).all()
    assert ((1 - below[:, 0] >= 0.5) == (grade(out) > 0)).mean() > 0.98


def test_best_threshold_is_the_best_of_all():
    r = np.random.default_rng(2)
    for _ in range(200):
        n = r.integers(2, 12)
        score, y, weight = np.round(r.random(n), 1), r.integers(0, 2, n), r.choice([0.5, 1.0, 3.0], n)
        if len(set(y.tolist())) < 2:
            continue

        def f1(t):
            hit = (score >= t) @ (y * weight)
            return 2 * hit / ((score >= t) @ weight + y @ weight)

        best = max(f1(t) for t in score)
        assert abs(f1(toxicity._best_threshold(score, y, weight)) - best) < 1e-9


def test_scores_are_those_of_plain_loops():
    """A text's score by loops over its words and filters, and over its features."""
    r = np.random.default_rng(6)
    texts = [" ".join(prose(n)) + end for n, end in ((1, ""), (2, "!"), (7, " Ünder-way"), (40, "\n"))] + ["", "  ", "x"]
    m = toxicity.new_model(3)
    m.bias, m.slope, m.shift = 0.2, 1.3, -0.4
    m.output = r.standard_normal(m.output.shape).astype(np.float32)
    m.offsets = [r.standard_normal(o.shape).astype(np.float32) for o in m.offsets]
    got = m.scores(*toxicity.word_buckets(pa.array(texts)))
    for text, score in zip(texts, got, strict=True):
        buckets, first = toxicity.word_buckets(pa.array([text]))
        words = [[x for k in range(toxicity.TABLES) for x in m.tables[k][buckets[k][i]]] for i in range(int(first[-1]))] + [[0.0] * toxicity.DIMENSIONS] * toxicity.PAD
        z = m.bias
        for i, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                at = [sum(words[s + j][d] * m.filters[i][j * toxicity.DIMENSIONS + d][f] for j in range(width) for d in range(toxicity.DIMENSIONS)) for s in range(int(first[-1]))]
                z += m.output[i * toxicity.FILTERS + f] * (max(0.0, max(at) + m.offsets[i][f]) if at else 0.0)
        assert abs(score - 1 / (1 + np.exp(-(m.slope * z + m.shift)))) < 1e-5, text
    q = quality_model.Model(r.standard_normal(quality_model.BUCKETS), np.array([-0.5, 0.7]))
    s = q.scores(*quality_model.features(pa.array(texts)))
    for text, have in zip(texts, s, strict=True):
        buckets, first = quality_model.features(pa.array([text]))
        n = int(first[-1])
        want = sum(q.weights[b] for row in buckets for b in row[:n]) / n if n else 0.0
        assert abs(have - want) < 1e-9
        assert np.allclose(q.below(np.array([have]))[0], [1 / (1 + np.exp(-(c - want))) for c in q.cuts])


def test_gradients_are_the_slopes_of_the_loss():
    """One step of training against differences of the loss: the convolution's parameters one by one."""
    texts, y = pa.array(["good day to all", "bad bad words here", "a fine text", "really bad"]), np.array([0, 1, 0, 1])
    m = toxicity.new_model(1)
    buckets, first = toxicity.word_buckets(texts)

    def loss():
        p = toxicity.sigmoid(m.logits(buckets, first).astype(float))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    pooled, at, _ = m.pooled(buckets, first, places=True)
    g = (toxicity.sigmoid(pooled @ m.output + m.bias) - y) / 4
    slope = pooled.T @ g
    for k in np.flatnonzero(np.abs(slope) > 1e-4)[:8]:
        was = m.output[k]
        m.output[k] = was + 1e-2
        up = loss()
        m.output[k] = was - 1e-2
        down = loss()
        m.output[k] = was
        assert abs((up - down) / 2e-2 - slope[k]) < 1e-3
    before = loss()
    m = toxicity.train(texts, y, np.ones(4))
    assert loss() < before / 2


def test_queries_learn_from_the_other_folds_only(spark):
    """The queries' own fit at a scale with labels: held-out rows, and the languages' thresholds."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = QUERIES["op2_toxicity"](spark, sf).collect()
    assert len(rows) == pq.read_table(f"{sf}/documents.parquet").num_rows and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    y = np.array([labels[r["doc_id"]]["toxic"] for r in out])
    assert auc(np.array([r["score"] for r in out]), y) > 0.93 and np.mean(np.array([r["predicted"] for r in out]) == y) > 0.96
    assert len({r["threshold"] for r in rows}) > 1 and all(r["flagged"] == (r["score"] >= r["threshold"]) for r in rows)
    grades = {r["doc_id"]: r for r in QUERIES["op10_quality_model"](spark, sf).collect()}
    good = np.array([labels[r["doc_id"]]["quality"] for r in out])
    assert np.mean(np.array([grades[r["doc_id"]]["kept"] for r in out]) == (good == 1)) > 0.98
    assert all(abs(r["expected_grade"] - r["tail_probability"]) <= 1 and 0 <= r["tail_probability"] <= 1 for r in grades.values())


def test_repeated_labels_and_long_texts_in_the_sample(spark, monkeypatch):
    from pyspark.sql import functions as F

    from trawlspark.llm import samples

    monkeypatch.setattr(samples, "SAMPLE_CHARS", 50)
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    docs = spark.createDataFrame([(k, "x" * 60 if k == ids[0] else f"text {k}") for k in ids] + [(ids[1], "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids] + [(ids[2], 1), (ids[2], 0), (ids[2], 1), (None, 1)], "doc_id long, y int")
    texts, y, weight = samples.labelled_sample(docs, labels, F.col("y"), 100, 2)
    got = dict(zip(texts.field("doc_id").to_pylist(), y.tolist(), strict=True))
    assert got == {k: 1 if k == ids[2] else k % 2 for k in ids[1:]} and len(texts) == len(got) and abs(weight.mean() - 1) < 1e-9


def test_gradient_of_the_ordinal_loss():
    """A few steps lower the loss: the slopes by weights and cuts point the right way."""
    texts = pa.array([" ".join(["good"] * 5 * g + ["bad"] * 5 * (2 - g)) for g in (0, 1, 2)] * 20)
    grade = np.array([0, 1, 2] * 20)
    m = quality_model.train(texts, grade, np.ones(60), 3)
    s = m.scores(*quality_model.features(texts))
    assert s[0] < s[1] < s[2] and m.below(s)[0, 0] > 0.9 and m.below(s)[2, 1] < 0.1


# ---- pipeline -------------------------------------------------------------------------------------


def test_pipeline(spark, documents):
    """Each stage against what plain Python makes of its own input."""
    docs, columns = documents, documents.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = [r.asDict() for r in docs.collect()]
        out = common.materialize(stage(spark, docs, SF), "stage")
        got = {r["doc_id"]: r.asDict() for r in out.collect()}
        if name != "bpe":
            assert out.columns == columns
        if name == "quality rules":
            assert all(n >= 10 and 5 * rep <= n for n, *_, rep in (brute.base_counts(r["text"]) for r in got.values()))
            assert set(got) == {r[0] for r in compare.connect(SF).sql(f"SELECT doc_id FROM ({oracles.OP5}) WHERE kept").fetchall()} and len(got) > len(rows) / 2
        elif name == "line dedup":
            gone = brute.boilerplate([(r["source"], r["text"]) for r in rows], line_dedup.MIN_SITES)
            assert {i: r["text"] for i, r in got.items()} == {r["doc_id"]: brute.without_lines(r["text"], gone) for r in rows}
        elif name == "near dedup":
            assert set(got) == {i for i, (*_, kept) in brute.near_duplicates([(r["doc_id"], r["text"]) for r in rows]).items() if kept}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
            assert set(got) == {r["doc_id"] for r in rows} - {i for i, _ in brute.contaminated([(r["doc_id"], r["text"]) for r in rows], items)}
        else:
            assert {i: r["decoded_sha256"] for i, r in got.items()} == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in rows}
        docs = out


@pytest.mark.parametrize("name", ["op1_minhash_dedup", "op4_line_dedup", "op5_quality_rules", "op6_substring_dedup", "op7_chat_format"])
def test_sql(spark, name):
    assert compare.differences(QUERIES[name](spark, SF), compare.connect(SF), oracles.SQL[name]) == ""


def test_clashing_columns_of_the_other_tables(spark):
    """Extra columns of labels, benchmark and conversations take no part."""
    extra = lambda df: df.selectExpr("*", *(f"'extra' AS `{c}`" for c in ("y", "own", "again", "rows", "source", "plain", "key", "items") if c not in df.columns))
    docs = spark.createDataFrame([(k, f"some words of text {k}", "en") for k in range(30)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(30)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "some words of text 7")], "item_id long, text string")
    talk = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "x" * 200_000), (2, None, "assistant", "a < b")], "conv_id long, turn long, role string, text string")
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    assert same(toxicity.toxicity(docs, labels), toxicity.toxicity(docs, extra(labels))) and same(quality_model.grade_documents(docs, labels), quality_model.grade_documents(docs, extra(labels)))
    assert same(decontaminate.decontaminate(docs, items), decontaminate.decontaminate(docs, extra(items)))
    one, two = (chat_format.digests(chat_format.format_conversations(t)) for t in (talk, extra(talk)))
    assert same(one, two) and {r["loss_chars"] for r in one.collect()} == {200_000, 5}


def test_pipeline_of_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF), "stage")
        assert docs.count() == 0


def test_pipeline_takes_odd_rows(spark):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(ODD)


def test_near_dedup_leaves_one_row_of_each_group(spark):
    a, b = " ".join(prose(30)), " ".join(prose(30))
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (None, b), (3, "alone"), (4, "x y z"), (4, "another text"), (None, "no id"), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).selectExpr("*", "'extra' AS row", "map('a', doc_id) AS kept")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert left == sorted([(1, a), (None, b), (3, "alone"), (4, "x y z"), (4, "another text"), (None, "no id"), (9, None)], key=repr)


def test_python_stages_get_batches_of_bounded_bytes(spark):
    """A task's rows reach Python a few megabytes at a time, not the whole task at once (the pipeline's executors ran out of memory)."""
    from trawlspark import shipping

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes], "n": [b.num_rows]})

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('word ', 1000) AS text")
    got = shipping.map_arrow(texts, sizes, "size long, n long").collect()
    assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) < 1.1 * shipping.ARROW_BYTES

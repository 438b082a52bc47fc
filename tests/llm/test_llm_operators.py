"""The operators' own interfaces: texts, spans, pairs and models, on small tables."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from brute import contained, simhash
from brute import line_dedup as line_brute
from brute import substring_dedup as substring_brute
from pyspark.sql import functions as F

import corpus_pipeline
from noteflow.llm import (
    byte_bpe,
    common,
    components,
    decontamination,
    fingerprints,
    language_id,
    license_scan,
    line_dedup,
    pii_surrogates,
    simhash_dedup,
    substring_dedup,
    toxicity,
)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# ---- 1 -----------------------------------------------------------------------

PRIVATE = (
    "Mr. John Smith, john.smith@mail.example.com, +1 (017) 555-7713, 10.20.30.40, 4111 1111 1111 1111",
    "Mrs. Mary Smith wrote to JOHN.SMITH@mail.example.com from +1 017 555 7713; card 4111111111111111",
    "Господин Иванов и Госпожа Мария Иванова",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", SSN 123-45-6789',
    "Nothing private here, version 2.0 of 1999.",
)


def test_surrogates_keep_type_format_and_coreference(spark):
    found = {r.doc_id: r for r in pii_surrogates.replace(docs(spark, *PRIVATE)).collect()}
    for secret in ("Smith", "john.smith", "555-7713", "10.20.30.40", "4111", "Иванов", "04dbebab", "123-45-6789"):
        assert not any(secret.lower() in r.text.lower() for r in found.values())
    shape = lambda s: re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", s))
    assert shape(found[3].text) == shape(PRIVATE[3]) and found[4].text == PRIVATE[4] and found[4]._n_entities == 0
    first, second = found[0].text, found[1].text
    assert re.match(r"Mr\. (\w+) (\w+),", first)[1] in pii_surrogates.MALE_NAMES
    assert re.match(r"Mrs\. (\w+) ", second)[1] in pii_surrogates.FEMALE_NAMES
    assert re.match(r"Mr\. \w+ (\w+)", first)[1] == re.match(r"Mrs\. \w+ (\w+)", second)[1]
    mail = re.search(r"\S+@\S+\.com", first)[0]
    assert re.search(r"\S+@\S+\.com", second)[0] == mail.upper().split("@")[0] + "@" + mail.split("@")[1]
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(re.search(r"\+1 \(.*?-\d{4}", first)[0]) == digits(re.search(r"\+1 \d+ \d+ \d+", second)[0])
    assert re.fullmatch(r"[А-Яа-яё ]+", found[2].text) and re.search(r"\b(\w+)$", found[2].text)[1] != "Иванова"
    card = re.search(r"(?:\d{4} ?){4}$", first)[0]
    sums = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits(card)))]
    assert sum(s - 9 * (s > 9) for s in sums) % 10 == 0


def test_names_without_titles(spark):
    (row,) = pii_surrogates.replace(docs(spark, "Then Anna Weber met Peter Weber. The Weber Dam, Paul and Emma left.")).collect()
    she, one, he, two, three = re.match(r"Then (\w+) (\w+) met (\w+) (\w+)\. The (\w+) Dam, Paul and Emma left\.", row.text).groups()
    assert she in pii_surrogates.FEMALE_NAMES and he in pii_surrogates.MALE_NAMES and one == two == three != "Weber"


def test_one_name_has_one_surrogate_whatever_stands_before_it(spark):
    texts = ("Dr. Erik Weber saw Mr. Erik Weber.", "Mr. John Smith said. Smith agreed, SMITH'S dog and Smithson too. Prof. Smith left.", "Dr. Erik Holm")
    first, second, third = [r.text for r in pii_surrogates.replace(docs(spark, *texts)).orderBy("doc_id").collect()]
    one, name, again, same = re.match(r"Dr\. (\w+) (\w+) saw Mr\. (\w+) (\w+)\.", first).groups()
    assert (one, name) == (again, same) and one != "Erik" and name != "Weber" and third.startswith(f"Dr. {one} ")
    john, smith, bare, loud, last = re.match(r"Mr\. (\w+) (\w+) said\. (\w+) agreed, (\w+)'S dog and Smithson too\. Prof\. (\w+) left\.", second).groups()
    assert smith == bare == last == loud.capitalize() and loud == smith.upper() and smith != "Smith" and john != "John"


SCRIPTS = {
    "Dvořák": "LATIN", "Yıldırım": "LATIN", "Wałęsa": "LATIN", "Їжак": "CYRILLIC", "Պետրոսյան": "ARMENIAN", "Γιώργος": "GREEK",
    "Wolfeschlegelsteinhausenbergerdorffwelche" * 3: "LATIN", "O’Brien-Smith": "LATIN",
}


def test_script_is_kept(spark):
    """Every letter of the new name is of the old one's script, and nothing of a long one is left."""
    found = pii_surrogates.replace(docs(spark, *[f"Mr. Adam {name}, then." for name in SCRIPTS])).orderBy("doc_id").collect()
    for (name, script), row in zip(SCRIPTS.items(), found):
        new = re.match(r"Mr\. \S+ (\S+), then\.", row.text)[1]
        assert new != name and len(new) == len(name)
        assert all(unicodedata.name(c).startswith(script) for c in new if c.isalpha())
        assert not any(new[i : i + 12] in name for i in range(len(name) - 11))


def test_long_tokens_and_other_numbers_go(spark):
    secrets = ("0123456789abcdef" * 9 + "a", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "020 7946 0958", "01 42 68 53 00")
    found = [r.text for r in pii_surrogates.replace(docs(spark, *[f"here {s} there" for s in secrets])).orderBy("doc_id").collect()]
    shape = lambda s: re.sub(r"\d|[a-f]", "9", s)
    for secret, text in zip(secrets, found):
        assert secret not in text and secret[-8:] not in text and shape(text) == shape(f"here {secret} there")


def test_columns_of_any_name_pass_through(spark):
    rows = [(1, "Mr. John Smith", "a", "b", "c"), (2, "nothing", "d", "e", "f"), (3, None, "g", "h", "i"), (4, "1 sign", "j", "k", "l")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _parts string, _pii_held string, `a.b` string")
    found = {r.doc_id: r for r in pii_surrogates.replace(frame).collect()}
    assert [tuple(found[i][c] for c in ("_parts", "_pii_held", "a.b")) for i in (1, 2, 3, 4)] == [tuple(r[2:]) for r in rows]
    assert "Smith" not in found[1].text and [found[i].text for i in (2, 3, 4)] == [r[1] for r in rows[1:]]
    assert [found[i]._n_entities for i in (1, 2, 3, 4)] == [2, 0, 0, 0]


def test_surrogates_are_keyed_and_distinct(spark):
    names = [f"Mr. {a}{b}" for a in ("Li", "Wu", "Xu", "Bo", "Ka", "Fa", "Ra") for b in ("", "n", "m", "s", "k")]
    frame = docs(spark, *names)
    one = [r.text for r in pii_surrogates.replace(frame).orderBy("doc_id").collect()]
    assert len(set(one)) == len(names) and not set(one) & set(names)
    other = [r.text for r in pii_surrogates.replace(frame, key="another").orderBy("doc_id").collect()]
    assert one != other


def test_surrogates_where_room_is_little(spark):
    """All short numbers of a country code, short addresses, and addresses without a letter."""
    texts = [f"+1{n:03}" for n in range(1000)] + [f"{a}@b.io" for a in "abcdefghijklm"] + ["_@-.com", "__@-.com"]
    frame = docs(spark, *texts)
    found = [r.text for r in pii_surrogates.replace(frame).collect()]
    assert len(set(found)) == len(texts) and not set(found) & set(texts)
    assert all(re.fullmatch(r"\+1\d+|\w+@[\w-]\.(io|com)", t) for t in found)


def test_surrogate_of_one_number_in_all_spellings(spark):
    spellings = ("+1 212 555 7713", "+12125557713", "+1(212)5557713", "+1-212-555.7713")
    found = [r.text for r in pii_surrogates.replace(docs(spark, *spellings, "(212) 555-7713")).orderBy("doc_id").collect()]
    bare = [re.sub(r"\D", "", t) for t in found]
    assert len(set(bare[:4])) == 1 and bare[0][0] == "1" and bare[0] != "12125557713" and bare[4] != bare[0][1:]
    assert [re.sub(r"\d", "9", t) for t in found[:4]] == [re.sub(r"\d", "9", t) for t in spellings]
    # what is written is what was compared: spellings of neighbouring numbers stay apart too
    texts = [f"+1{n:03}" for n in range(0, 1000, 2)] + [f"+1 {n:03}" for n in range(1, 1000, 2)] + [f"+1 {n:03}" for n in range(0, 1000, 2)]
    found = [re.sub(r" ", "", r.text) for r in pii_surrogates.replace(docs(spark, *texts)).orderBy("doc_id").collect()]
    assert found[:500] == found[1000:] and len(set(found)) == 1000


def test_separators_that_carry_meaning(spark):
    texts = ("10.1.1.11", "10.1.11.1", "10.11.1.1", "john@smith.com", "johns@mith.com", "JOHN@smith.com", "4111-1111-1111-1111", "4111111111111111")
    found = [r.text for r in pii_surrogates.replace(docs(spark, *texts)).orderBy("doc_id").collect()]
    assert len({t.lower().replace("-", "") for t in found}) == 6 and found[3] == found[5].lower()
    assert found[6].replace("-", "") == found[7]


def test_entities_in_the_driver_documents_go(spark, sf_dir):
    held = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    before = "\n".join(r.text for r in held.collect())
    after = "\n".join(r.text for r in pii_surrogates.replace(held).collect())
    secrets = set(re.findall(r"\w[\w.]*@[\w.]+\w|\+\d \(\d+\) \d+-\d+|\b\d{16}\b|\b[0-9a-f]{40}\b", before))
    assert secrets and not any(s in after for s in secrets)


# ---- 2 -----------------------------------------------------------------------

def test_spans_of_repeated_windows(spark):
    draw = random.Random(3)
    text = lambda n: " ".join(str(draw.randrange(10**6)) for _ in range(n))
    passage = text(50)
    frame = docs(spark, f"{text(10)} {passage} {text(10)}", f"{passage} {text(40)}", text(300))
    found = {r.doc_id: (list(r.begins), list(r.ends)) for r in substring_dedup.repeated_spans(frame).collect()}
    assert found == {0: ([10], [60]), 1: ([0], [50])}
    kept = {r.doc_id: r.text for r in substring_dedup.remove(frame, substring_dedup.repeated_spans(frame)).collect()}
    assert len(kept[0].split()) == 20 and kept[2] == frame.where("doc_id = 2").first().text


@pytest.mark.parametrize("n", [18, 19, 60])
def test_equal_windows_share_a_chosen_seed(n):
    draw = np.random.default_rng(n)
    for _ in range(50):
        hashes = draw.integers(0, 5, n).astype(np.uint64)  # many ties
        chosen = set(substring_dedup.chosen(hashes, 18).tolist())
        for i in range(n - 17):
            window = hashes[i : i + 18]
            assert {i + int(k) for k in np.flatnonzero(window == window.min())} <= chosen


@pytest.mark.parametrize(("window", "least"), [(1, 16), (8, 16), (35, 16), (35, 5), (100, 16)])
def test_windows_of_any_length(spark, window, least):
    """The level loop removes what brute force removes, whatever the number of levels."""
    lengths = substring_dedup.levels(window, least)
    assert lengths[-1] == window and all(b <= 2 * a for a, b in zip(lengths, lengths[1:]))
    draw = random.Random(window)
    words = [f"w{i}" for i in range(40)]
    passages = [[draw.choice(words) + str(draw.randrange(1, 4) if n else "") for _ in range(n + 30)] for n in (5, 30, 70, 120, 200)]
    texts: list[str | None] = [None, "", "a a a a a a a a a a a a a a a"]
    for _ in range(25):
        own = []
        for _ in range(draw.randrange(1, 4)):
            passage = draw.choice(passages)
            a, b = sorted(draw.sample(range(len(passage) + 1), 2))
            own += [*passage[a:b], *(str(draw.randrange(10**6)) for _ in range(draw.randrange(0, 3)))]
        texts.append(" ".join(own))
    held = docs(spark, *texts)
    found = substring_dedup.remove(held, substring_dedup.repeated_spans(held, window, least)).collect()
    expected = {d: (n, gone) for d, n, gone, _ in substring_brute(list(enumerate(texts)), window)}
    assert {r.doc_id: (r._n_words, r._n_removed) for r in found} == expected
    assert window == 100 or any(gone for _, gone in expected.values())


# ---- 3, 10 -------------------------------------------------------------------

def test_language_of_held_out_documents(spark):
    held = common.table(spark, "/root/testdata/sf0.01", "documents")
    found = language_id.predict(held, language_id.fit(held)).join(held.select("doc_id", "lang"), "doc_id")
    rows = found.where(language_id.held_out()).collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_letterless_and_foreign_texts(spark):
    rows = [("en", "the cat and the other hat") for _ in range(9)] + [("de", "der Hund und die andere Katze") for _ in range(9)]
    model = language_id.train(rows)
    asked = docs(spark, None, "", "123 !?", "the other cat", "der andere Hund", "漢字だけの文章")
    found = {r.doc_id: r for r in language_id.predict(asked, model).collect()}
    assert [found[i].lang_pred for i in range(5)] == ["und", "und", "und", "en", "de"]
    assert language_id.predict(asked, None).where("lang_pred <> 'und'").count() == 0
    assert language_id.accepted(asked, None).count() == 0
    stays = {r.doc_id for r in language_id.accepted(asked.withColumn("score", F.lit(1)), model).collect()}
    assert stays == {3, 4}


FOREIGN = (
    "Türkiye'nin en kalabalık şehri İstanbul olup ülkenin ekonomik ve kültürel merkezidir",
    "Москва является столицей России и крупнейшим городом",
    "漢字だけの文章です",
    "xkcd qwrtp zxcvb mnbvc lkjhg fdsqp wrtpz",
    "Helsinki on Suomen pääkaupunki ja suurin kaupunki, jossa asuu paljon ihmisiä",
    "asdf jkl qwer uiop zxcv",
    "Warszawa jest stolicą Polski i największym miastem",
)


@pytest.mark.parametrize("languages", [("en", "de"), ("en", "de", "fr", "es")])
def test_foreign_texts_go_and_held_out_ones_stay(spark, languages):
    """Whatever the number of languages."""
    held = common.table(spark, "/root/testdata/sf0.01", "documents").where(F.col("lang").isin(*languages))
    model = language_id.fit(held)
    assert language_id.accepted(docs(spark, *FOREIGN), model).count() == 0
    out = held.where(language_id.held_out() & F.col("text").rlike("[A-Za-z]"))
    stays = language_id.accepted(out, model)
    assert stays.columns == held.columns and stays.count() >= 0.98 * out.count() > 50


def test_many_languages_are_all_learned(spark):
    """More than two landmarks each would be; the words of each language are its own."""
    draw = random.Random(3)
    rows = []
    for lang in range(300):
        own = ["".join(chr(0x4E00 + 40 * lang + draw.randrange(40)) for _ in range(4)) for _ in range(30)]
        rows += [(len(rows) + i, " ".join(draw.choices(own, k=30)), f"l{lang:03}") for i in range(12)]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(held)
    assert len(model.languages) == 300 and model.present[0].shape[1] <= language_id.MOST_LANDMARKS
    found = language_id.predict(held, model).join(held, "doc_id").where(language_id.held_out()).collect()
    right = np.mean([r.lang == r.lang_pred for r in found if r.lang in {model.languages[i] for i in range(0, 300, 2)}])
    assert len(found) > 500 and right > 0.9


def test_sample_is_bounded_and_repeatable(spark, monkeypatch):
    """Rows that repeat one id with other texts, or repeat whole, neither swell the sample nor make it a matter of order."""
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 20)
    seen = []
    monkeypatch.setattr(language_id, "train", lambda rows: seen.append(rows))
    rows = [(1 + i % 2, f"text number {i // 3} of one id", ("en", "de")[i % 2]) for i in range(3000)]
    for parts in (1, 7):
        language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts))
    assert seen[0] == seen[1] and 0 < len(seen[0]) <= 20 and len(set(seen[0])) == len(seen[0])


def test_kernel_of_plain_python():
    """Kernel values are shared n-grams over the geometric mean of both counts, averaged over the lengths."""
    rows = [("hi", "नमस्ते दुनिया यह"), ("en", "the cat and the hat"), ("en", "a dog, 3 hats"), ("hi", "यह एक घर है")]
    model = language_id.train(rows)
    assert language_id.letters("नमस्ते 3 The") == " नमस्ते the "
    sets = lambda text: [{text[i : i + n] for i in range(len(text) - n + 1)} for n in (1, 2, 3)]
    marks = [sets(language_id.letters(t)) for lang in ("en", "hi") for own, t in rows if own == lang]
    for asked in ("the other cat", "x", "एक the"):
        text = language_id.letters(asked)
        plain = [sum(len(a & b) / (len(a) * len(b)) ** 0.5 for a, b in zip(sets(text), m)) / 3 for m in marks]
        assert np.allclose(model.kernel([language_id.grams(text)])[0], [*plain, 1], atol=1e-6)


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    held, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    found = toxicity.tag(held, toxicity.fit(held, labels)).join(labels, "doc_id").where(toxicity.held_out()).collect()
    caught = [r for r in found if r.score >= toxicity.THRESHOLD]
    assert np.mean([r.toxic for r in caught]) > 0.9
    assert sum(r.toxic for r in caught) >= 0.6 * sum(r.toxic for r in found)


def test_toxic_spans_and_gaps(spark):
    draw = random.Random(5)
    plain = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(1, f"{plain(20)} rotten fool {plain(20)}") for _ in range(40)] + [(0, plain(40)) for _ in range(40)]
    model = toxicity.train(rows)
    text = f"{plain(3000)} you Rotten fool, {plain(500)}"
    (row,) = toxicity.tag(docs(spark, text), model).collect()
    assert [text[s.begin : s.end] for s in row.spans] == ["Rotten", "fool"] and row.score > 0.7
    assert toxicity.tag(docs(spark, plain(50), None), model).where("score > 0.3").count() == 0
    # the powers over gaps give what going token by token gives
    tokens = toxicity._TOKENS.findall(text)
    sites, chance = model.marginals(tokens)
    scores = np.nan_to_num(model.emissions(tokens)) + model.bias
    slow, _ = toxicity._expectations(scores[None, :], model.moves, np.ones((1, len(tokens)), bool))
    assert np.allclose(slow[0][sites], chance, atol=1e-6)


# ---- 4 -----------------------------------------------------------------------

def test_no_containment_is_missed(spark):
    """A document that holds just enough of an item holds as many of its min-hashes as it must, whichever it lacks."""
    draw = random.Random(4)
    names = [[f"i{i}w{w}" for w in range(size + 4)] for i, size in enumerate((1, 2, 3, 5, 9, 20, 21, 60))]
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(names)], "item_id long, text string")
    texts = []
    for own in names:
        for cut in range(0, len(own), max(1, len(own) // 12)):  # from either end, and a changed word
            texts += [" ".join(own[:cut]), " ".join(own[cut:]), " ".join([*own[:cut], "x", *own[cut + 1 :]])]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    found = {(r.doc_id, r.item_id) for r in decontamination.contained(docs(spark, *texts), items).collect()}
    assert found == {r[:2] for r in contained(rows, list(enumerate(map(" ".join, names))))}


def test_common_shingles_make_no_candidates(spark):
    """Items and documents that share one phrase are no candidates, and items of common shingles alone are found."""
    phrase = "choose the one right answer below"
    items = [(i, f"{phrase} " + " ".join(f"q{i}w{w}" for w in range(20))) for i in range(300)]
    items += [(400 + i, phrase if i < 20 else f"{phrase} of{i}") for i in range(40)]
    texts = [f"{phrase} " + " ".join(f"d{i}w{w}" for w in range(30)) for i in range(200)] + [items[7][1], phrase]
    table = spark.createDataFrame(items, "item_id long, text string")
    sketch = decontamination.sketches(decontamination.shingle_sets(table))
    met = decontamination.candidates(docs(spark, *texts).where("doc_id < 200"), sketch.join(
        decontamination.shingle_sets(table.where("item_id < 300")).select("set_id"), "set_id"))
    assert met.count() == 0
    found = {(r.doc_id, r.item_id) for r in decontamination.contained(docs(spark, *texts), table).collect()}
    assert found == {r[:2] for r in contained(list(enumerate(texts)), items)} and (200, 7) in found and (201, 400) in found


def test_small_items_do_not_raise_what_large_ones_are_sent(spark):
    large = [(i, " ".join(f"l{i}w{w}" for w in range(300))) for i in range(20)]
    small = [(100 + i, " ".join(f"s{i}w{w}" for w in range(5))) for i in range(50)]
    bounds = [
        decontamination.class_bounds(decontamination.sketches(decontamination.shingle_sets(
            spark.createDataFrame(items, "item_id long, text string")))) for items in (large, large + small)
    ]
    assert len(bounds[0]) == 1 and len(bounds[1]) == 2 and bounds[0].items() <= bounds[1].items()
    frame = docs(spark, *(" ".join(f"d{d}w{w}" for w in range(2000)) for d in range(3)))
    kind = next(iter(bounds[0]))
    sent = [decontamination.sent_hashes(frame, b).where(F.col("size_class") == kind).count() for b in bounds]
    assert sent[0] == sent[1] < 0.7 * 3 * 1996


def test_decontaminate_keeps_clean_documents(spark):
    item = " ".join(f"item{i}" for i in range(30))
    held = docs(spark, f"before {item.upper()} after", " ".join(item.split()[:12]), "clean", None).withColumn("item_id", F.lit(1))
    items = spark.createDataFrame([(1, item), (2, "clean")], "item_id long, text string")
    kept = decontamination.decontaminate(held, items)
    assert kept.columns == held.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3}


# ---- 5 -----------------------------------------------------------------------

def test_offsets_and_split_characters(spark):
    text = "Grüße 🙂🙂 漢字 end"
    (row,) = byte_bpe.encode(docs(spark, text)).collect()
    assert row.starts[0] == 0 and row.ends[-1] == len(text)
    assert all(a <= c for a, c in zip(row.starts, row.starts[1:])) and any(a == c for a, c in zip(row.starts, row.starts[1:]))
    back = byte_bpe.decode(byte_bpe.encode(docs(spark, text, None, ""))).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in back] == [text, "", ""] and back[1].n_tokens == 0


def test_parts_of_long_texts_encode_like_the_whole(monkeypatch):
    draw = random.Random(2)
    text = "".join(draw.choice(["ab", " ", "\n", "1", "é", "  ", " ", "'s", "!"]) for _ in range(4000))
    codec = byte_bpe.Codec(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    whole = codec.ids(text).tolist()
    monkeypatch.setattr(byte_bpe, "PART", 50)
    assert codec.ids(text).tolist() == whole and len(byte_bpe._parts(text)) > 20


# ---- 6 -----------------------------------------------------------------------

def test_edited_license_texts_are_found(spark):
    grant = license_scan.TEMPLATES[1][0].split()
    grant[8:9] = ["somebody", "else"]
    found = license_scan.spans(docs(spark, f"intro words {' '.join(grant).title()} outro", "any person obtaining"))
    (row,) = found.collect()
    assert row.label == "mit" and not row.base and row.first_word == 2 and row.coverage > 0.8


NEAR_LICENSES = (
    ("Licensed under CC BY-SA 4.0", ""),
    ("Licensed under CC BY-ND 4.0", ""),
    ("Licensed under CC BY-NC-SA 4.0", ""),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-NC 3.0", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0 or CC BY-NC 4.0", "cc-by-nc"),
    ("licensed under the Mozilla Public License, version 2.0", ""),
    ("licensed under the GNU General Public License version 2.0", "gpl"),
    ("licensed under the very Apache License, version 2.0", "apache"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("licensed under a Creative Commons Attribution-Non-Commercial 4.0 International License", "cc-by-nc"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ""),
    ("licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", ""),
    ("This work is licensed under the GNU Lesser General Public License version 3", "gpl"),  # by its phrase alone
    ("You may not use this work except in compliance with the Licence", ""),
)


def test_near_licenses_are_told_apart(spark):
    held = docs(spark, *[text for text, _ in NEAR_LICENSES])
    found = {r.doc_id: r.labels for r in license_scan.scanned(held).collect()}
    assert [found[i] for i in range(len(found))] == [label for _, label in NEAR_LICENSES]
    gpl = license_scan.spans(held).where("label = 'gpl' AND NOT base").collect()
    assert {r.doc_id for r in gpl} == {7}  # the lesser license is none


def test_sql_of_the_license_scan_has_its_verification(spark, tmp_path):
    """The SQL on the same near licenses, and on them in longer texts."""
    texts = [text for text, _ in NEAR_LICENSES]
    texts += [f"word {a} or else {b} end" for a, b in zip(texts, texts[3:])] + ["", None, "mit license mit license"]
    docs(spark, *texts).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = license_scan.op6_license_scan(spark, str(tmp_path))
    theirs = sorted(con.execute(license_scan.OP6_SQL).fetchall(), key=repr)
    assert sorted(map(tuple, found.collect()), key=repr) == theirs
    assert {r[0]: r[6] for r in theirs if r[0] < len(NEAR_LICENSES)} == {i: label for i, (_, label) in enumerate(NEAR_LICENSES)}


IDENTIFIED = (
    ("// SPDX-License-Identifier: MIT", "mit"),
    ("# SPDX-License-Identifier: MIT-0", ""),
    ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "apache"),
    ("SPDX-License-Identifier: Apache-1.1", ""),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl"),
    ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl"),
    ("SPDX-License-Identifier: CC-BY-4.0", "cc-by"),
    ("SPDX-License-Identifier: CC-BY-NC-4.0", "cc-by-nc"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", ""),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("SPDX-License-Identifier: Proprietary", ""),
    ("the license identifier mit", "mit"),
    ("redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl,gpl"),
    ("redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gpl,lgpl"),
    ("redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("The contents of this file are subject to the terms of the Common Development and Distribution License", "cddl"),
    ("In no event shall the authors or copyright holders be liable for any claim, damages arising from the use of the software", ""),
    ("In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
)


def test_identifiers_and_sentences_of_further_licenses(spark, tmp_path):
    held = docs(spark, *[text for text, _ in IDENTIFIED])
    held.write.parquet(str(tmp_path / "documents.parquet"))
    found = license_scan.op6_license_scan(spark, str(tmp_path))
    assert {r.doc_id: r.labels for r in found.collect()} == {i: label for i, (_, label) in enumerate(IDENTIFIED)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(con.execute(license_scan.OP6_SQL).fetchall(), key=repr)


def test_word_pairs_are_made_once(spark):
    plan = license_scan.scanned(docs(spark, "mit license"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1


# ---- 7 -----------------------------------------------------------------------

def test_documents_without_an_own_id_are_spread(spark):
    """Rows that share an id, or have none, follow each other by their text's hash over several ranges."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    order = sorted(frame.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h), reverse=True)
    expected = {r.text: n.text for r, n in zip(order, [*order[1:], order[0]])}
    found = fingerprints.with_next(frame.drop("h")).collect()
    assert len(found) == 3000 and {r.text: r.next_text for r in found} == expected
    sizes = Counter(r["at"] for r in found)
    assert len(sizes) > 20 and max(sizes.values()) < 500
    assert len({r["at"] for r in found if r.doc_id is None}) > 5


def test_search_by_blocks_finds_all_in_the_radius(spark):
    draw = np.random.default_rng(4)
    centres = draw.integers(-(2**63), 2**63, 30)
    near = [int(c) ^ int(sum(1 << int(b) for b in draw.choice(63, draw.integers(0, 6), replace=False))) for c in centres for _ in range(10)]
    frame = spark.createDataFrame([(x,) for x in {*near, *map(int, centres)}], "bits long")
    bits = [r.bits for r in frame.collect()]
    expected = {(a, b) for a in bits for b in bits if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert {(r.asked, r.found) for r in fingerprints.within_radius(frame, frame).collect()} == expected


def test_likeness_of_edited_texts(spark, sf_dir):
    found = fingerprints.compared(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    edited, following = found.select(
        F.avg(fingerprints.likeness(F.col("bits"), F.col("edited_bits"))), F.avg(fingerprints.likeness(F.col("bits"), F.col("next_bits")))
    ).first()
    assert edited > following + 0.15


def test_fingerprint_bits(spark):
    """Votes in lanes against plain sums, with a text longer than a lane."""
    text = " ".join(f"w{i % 977}x{i % 13}" for i in range(5000))
    frame = docs(spark, text, "one", "", " two  words ").withColumn("t", F.split("text", r"\s+"))
    found = {r.doc_id: r.bits for r in fingerprints.fingerprints(frame, ["doc_id"], "text").collect()}
    for doc, own in [(0, text.split()), (1, ["one"]), (3, ["two", "words"])]:
        pairs = spark.createDataFrame([(a, b) for a, b in zip(["", *own], own)], "b string, w string")
        votes, total = [0] * 64, 0
        for r in pairs.select(F.xxhash64("b", "w").alias("h"), F.length("w").alias("n")).collect():
            weight = min(r.n, fingerprints.HEAVIEST)
            total += weight
            for b in range(64):
                votes[b] += weight * (r.h >> b & 1)
        assert found[doc] & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * votes[b] > total)
    assert found[2] == 0


# ---- 8 -----------------------------------------------------------------------

@pytest.mark.parametrize("partitions", [1, 16])
def test_common_line_over_many_ranges(spark, set_conf, partitions):
    """A line that all documents hold spans all ranges; only the largest document keeps it."""
    set_conf("spark.sql.shuffle.partitions", str(partitions))
    set_conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    line = "a line that everybody repeats"
    frame = docs(spark, *[f"{line}\nown line number {i} of its own\n{line.upper()}" for i in range(300)])
    kept = {r.doc_id: r.text.split("\n") for r in line_dedup.deduplicate(frame).collect()}
    assert [i for i, lines in kept.items() if line in lines] == [299]
    assert all(f"own line number {i} of its own" in kept[i] for i in kept)


@pytest.mark.parametrize(("partitions", "waiting", "edges"), [(1, 3, 1 << 20), (16, 3, 0), (16, 1024, 1 << 20)])
def test_lines_of_rows_that_share_an_id(spark, set_conf, monkeypatch, tmp_path, partitions, waiting, edges):
    """Many rows of one id, or of none, hold lines of few other documents: counted once, and not held at once."""
    set_conf("spark.sql.shuffle.partitions", str(partitions))
    set_conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(line_dedup, "WAITING", waiting)
    monkeypatch.setattr(line_dedup, "BROADCAST_EDGES", edges)
    line = [f"shared line number {i} of some length" for i in range(4)]
    rows = [(None, f"{line[0]}\n{line[1]}\nown line number {i} of no id") for i in range(400)]
    rows += [(5, f"{line[1]}\n{line[2]}\nown line number {i} of five\n{line[3]}") for i in range(400)]
    rows += [(9, f"{line[0]}\n{line[1]}"), (3, f"{line[0]}\n{line[2]}"), (2, line[2]), (1, line[3])] + [rows[0], rows[500]] * 50
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = line_dedup.op8_line_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(line_brute(rows), key=repr)


# ---- 9 -----------------------------------------------------------------------

def test_points_bound_distances():
    draw = np.random.default_rng(6)
    bits = draw.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)
    other = bits ^ np.array([sum(1 << int(b) for b in draw.choice(64, 4, replace=False)) for _ in bits], np.uint64)
    manhattan = np.bitwise_count(simhash_dedup._points(bits) ^ simhash_dedup._points(other))
    assert (manhattan <= np.bitwise_count(bits ^ other)).all()
    assert simhash_dedup._points(np.array([0b11_10_01_00], np.uint64))[0] == 0b11_01_01_00


@pytest.mark.parametrize("cell", [8192, 7])
def test_links_of_crowded_cells(spark, cell):
    draw = random.Random(8)
    base = draw.getrandbits(63)
    bits = {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)} | {draw.getrandbits(63) for _ in range(300)}
    frame = spark.createDataFrame([(b,) for b in bits], "bits long")
    root = {b: b for b in bits}
    for r in simhash_dedup.links(frame, cell=cell).collect():
        a, b = r.a, r.b
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def up(x):
        return x if root[x] == x else up(root[x])

    for a in bits:
        for b in bits:
            if (a ^ b).bit_count() <= 4:
                assert up(a) == up(b)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {(r.node, r.root) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)}


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(400))
    held = docs(spark, text, text, text.replace("word7 ", "other "), "something else entirely", None, None)
    held = held.union(held.where("doc_id = 0")).withColumn("root", F.lit("clash"))
    kept = simhash_dedup.deduplicate(held)
    assert kept.columns == held.columns
    near = bin(simhash(text) ^ simhash(text.replace("word7 ", "other "))).count("1") <= 4
    assert sorted(r.doc_id for r in kept.collect()) == sorted([0, 3, 4] + [2] * (not near))


def test_components_that_share_an_id_all_stay(spark):
    rows = [(None, "first text of nobody"), (None, "quite another thing"), (None, "third one, unlike both"), (None, "first text of nobody")]
    rows += [(18, "same same same"), (18, "other text of one id"), (19, "same same same"), (None, "other text of one id")]
    kept = simhash_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({simhash(text) for _, text in rows}) == 5
    assert sorted(map(tuple, kept), key=repr) == sorted({*rows[:3], *rows[4:6]}, key=repr)


# ---- pipeline ----------------------------------------------------------------

def test_pipeline_stages_keep_columns(spark, sf_dir):
    held = common.table(spark, sf_dir, "documents")
    sizes = [held.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, held, sf_dir)
        assert after.dtypes == held.dtypes, name
        held = corpus_pipeline.written(after, name)
        sizes.append(held.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1] > 0.7 * sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, held, sf_dir)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in held.collect()}


@pytest.mark.parametrize(("partitions", "waiting", "edges"), [(1, 3, 1 << 20), (16, 3, 0), (16, 1024, 1 << 20)])
def test_lines_of_rows_that_share_an_id(spark, set_conf, monkeypatch, tmp_path, partitions, waiting, edges):
    """Many rows of one id, or of none, hold lines of few other documents: counted once, and not held at once."""
    set_conf("spark.sql.shuffle.partitions", str(partitions))
    set_conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(line_dedup, "WAITING", waiting)
    monkeypatch.setattr(line_dedup, "BROADCAST_EDGES", edges)
    line = [f"shared line number {i} of some length" for i in range(4)]
    rows = [(None, f"{line[0]}\n{line[1]}\nown line number {i} of no id") for i in range(400)]
    rows += [(5, f"{line[1]}\n{line[2]}\nown line number {i} of five\n{line[3]}") for i in range(400)]
    rows += [(9, f"{line[0]}\n{line[1]}"), (3, f"{line[0]}\n{line[2]}"), (2, line[2]), (1, line[3])] + [rows[0], rows[500]] * 50
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = line_dedup.op8_line_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(line_brute(rows), key=repr)


# ---- 9 -----------------------------------------------------------------------

def test_bands_follow_the_number_of_fingerprints(spark):
    chosen = [simhash_dedup.bands_for(10**k) for k in range(13)]
    assert chosen == sorted(chosen) and chosen[0] == chosen[6] == simhash_dedup.BANDS and chosen[9] > simhash_dedup.BANDS
    assert simhash_dedup.bands_for(10, radius=8) >= 9
    draw = random.Random(6)
    base = [draw.getrandbits(63) for _ in range(30)]
    bits = sorted({b ^ sum(1 << i for i in draw.sample(range(63), draw.randrange(6))) for b in base for _ in range(6)})
    frame = spark.createDataFrame([(b,) for b in bits], "bits long")
    rooted = []
    for bands in (6, 7, 9):  # the same components by any number of bands
        found = components.components(simhash_dedup.links(frame, bands=bands, cell=16)).collect()
        rooted.append({r.node: r.root for r in found})
    assert rooted[0] == rooted[1] == rooted[2] and len(rooted[0]) > 30


# ---- 2, 8, 9: columns of any name ----------------------------------------------

CLASHING = (
    "row begins ends places single n_words n_removed froms tos _cut _own_text _mark_doc _mark_text _mark_keep _MARK_CUT _mark_begins "
    "_mark_ends _n_lines _n_dropped _n_words _n_removed _stays_doc _stays_text _Stays_Rank _stays_rank_ root bits text_hash a.b keep"
).split()


@pytest.mark.parametrize("name", ["substring", "line", "simhash", "decontamination", "language"])
def test_columns_that_operators_use_pass_through(spark, name):
    passage = "\n".join(f"this is line number {i} of the passage" for i in range(10))
    rows = [(i, t, *(f"{c} of {i}" for c in CLASHING)) for i, t in enumerate([passage, f"{passage}\nb", f"{passage}\nb c", "other words", None])]
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    held = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
    run = {
        "substring": lambda: substring_dedup.remove(held, substring_dedup.repeated_spans(held), names=()),
        "line": lambda: line_dedup.deduplicate(held),
        "simhash": lambda: simhash_dedup.deduplicate(held),
        "decontamination": lambda: decontamination.decontaminate(held, docs(spark, "nothing of this is there").withColumnRenamed("doc_id", "item_id")),
        "language": lambda: language_id.accepted(held, language_id.train([("en", passage), ("en", "other words")])),
    }[name]
    found = run()
    assert found.columns == held.columns
    before = {r[0]: r[2:] for r in rows}
    kept = found.collect()
    assert len(kept) >= 3 and all(tuple(r)[2:] == before[r.doc_id] for r in kept)
    if name in ("substring", "line"):
        assert len(kept) == 5 and any(r.text != rows[r.doc_id][1] for r in kept)


def test_names_of_counts_are_never_taken_twice(spark):
    held = docs(spark, "a", "b").withColumn("_N_LINES", F.lit("mine")).withColumn("_n_words", F.lit("mine"))
    with pytest.raises(ValueError, match="_n_lines"):
        line_dedup.apply_bitmaps(held, line_dedup.keep_bitmaps(held))
    with pytest.raises(ValueError, match="_n_words"):
        substring_dedup.remove(held, substring_dedup.repeated_spans(held))
    named = line_dedup.apply_bitmaps(held, line_dedup.keep_bitmaps(held), ("before", "lost")).first()
    assert named["_N_LINES"] == "mine" and (named.before, named.lost) == (1, 0)

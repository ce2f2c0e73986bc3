"""Secrets, quality rules, decontamination and repeated passages against plain versions."""

from __future__ import annotations

import time

import numpy as np
import pytest

from corpusloom.llm import decontaminate, quality_rules, secret_scan, substrings

from . import brute


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_secrets_base_and_added_spans(docs, texts):
    found = by_id(secret_scan.scan(docs, mark="[S]"))
    for i, text in enumerate(texts):
        base = brute.base_spans(text)
        row = found[i]
        assert row.base_spans == ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert set(filter(None, row.base_spans.split(","))) <= set(row.spans.split(","))
    assert found[0].redacted is None and found[1].redacted == ""
    last = [i for i, t in enumerate(texts) if t and t.startswith("pwd")][0]
    # Seven letters that are no word of the dictionary cost 26^7 guesses, more than the limit.
    assert found[last].n_guess == 3 and "Xk9" not in found[last].redacted and "Zq8" not in found[last].redacted


def test_secrets_no_part_of_a_value_survives(spark):
    """Values that reach beyond a fixed pattern, and tokens after the scheme of an authorization."""
    values = [
        ("password: {}", "abcdef123456!Zq#99xL"), ('password = "{}"', "Kestrelvolant harbour Tq8 plinth"),
        ("passphrase: {}", "Xy!0123456789abcdef#Wq9Lk"), ("Authorization: Bearer {}", "Gq7xT.Vw2pLs_9RkZ"),
        ("-H 'authorization: Basic {}' x", "UXo3eFZ3MnBMczlSa1o6"), ("token={}", "QwLk72hsPq90aa~Rt@v!"),
    ]
    texts = [f"before {form.format(value)} after" for form, value in values]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for found in (by_id(secret_scan.scan(docs, mark="[S]")), by_id(secret_scan.redact(docs, mark="[S]"))):
        for i, (_, value) in enumerate(values):
            text = found[i].redacted if "redacted" in found[i] else found[i].text
            assert not any(value[k : k + 3] in text for k in range(len(value) - 2)), text
            assert text.startswith("before ") and text.endswith((" after", " x after"))


def test_secrets_dropped_match_hides_what_it_covers():
    assert secret_scan.base_spans("token=secret:abcdefghijklmn") == []
    assert secret_scan.base_spans("TOKEN = secret=abcdefghijkl") == [(0, 0, 27)]


@pytest.mark.parametrize(("cheap", "dear"), [
    ("password", "pqxvwzjk"), ("P@ssw0rd", "Pq#xw0zd"), ("qwertyuiop", "qmwzbvxkeo"), ("aaaaaaaaaaaa", "akdjwmznvqpt"),
    ("abcabcabcabc", "qpxznvbwmkjd"), ("12/05/1987", "92/75/3846"), ("123456789", "583920174"),
])
def test_guess_cost_orders_values(cheap, dear):
    guesser = secret_scan.Guesser.of(secret_scan.WORDS)
    assert guesser.cost(cheap) < guesser.cost(dear) - 2


def test_guess_cost_is_the_cheapest_segmentation():
    """Against a search over all segmentations into words and single characters."""
    from math import log10

    guesser = secret_scan.Guesser.of(["cat", "dog", "catalog"])
    def plain(text):
        best = {0: 0.0}
        for end in range(1, len(text) + 1):
            best[end] = float("inf")
            for start in range(end):
                part = text[start:end]
                if part in guesser.ranks:
                    best[end] = min(best[end], best[start] + log10(guesser.ranks[part]) + log10(2))
                best[end] = min(best[end], best[start] + log10(2) + (end - start) * log10(26))
        return best[len(text)]

    for text in ("catdog", "catalogdog", "xcatwdogh", "catalox", "zmvqkw"):
        assert guesser.cost(text) == pytest.approx(plain(text))


def test_quality_rules_counts(docs, repeated, texts, nothing):
    found = by_id(quality_rules.quality_rules(docs))
    for i, text in enumerate(texts):
        n, chars, symbols, lines, covered = want = brute.rules(text)
        row = found[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (n < 10 or 100 * covered > 20 * n)
        assert not (row.base_failed and row.kept)
        assert (row.word_distance is None) == (n < 100)
    assert quality_rules.quality_rules(repeated).count() == 2 * len(texts)
    assert quality_rules.quality_rules(nothing).count() == 0


def test_divergence_is_a_distance_between_histograms():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.5, 0.5])
    assert quality_rules.divergence(p, p) == 0
    assert quality_rules.divergence(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality_rules.divergence(p, q) == pytest.approx(np.sqrt(0.5))


def test_quality_rules_find_other_distributions(spark):
    clean = [(i, " ".join(["the", "of", "and", f"word{i}"] * 40 + [f"q{i}{j}" for j in range(60)]), "en") for i in range(60)]
    upper = [(100, " ".join(f"AB{j}!!" for j in range(200)), "en"), (101, " ".join(f"zz{j}" for j in range(300)), "en")]
    df = spark.createDataFrame(clean + upper, "doc_id long, text string, lang string")
    found = by_id(quality_rules.quality_rules(df, max_repeat_percent=100))
    assert all(found[i].kept for i in range(60)) and not found[100].kept and not found[101].kept


ITEMS = [(1, None), (2, ""), (3, "One"), (4, "alpha beta"), (5, "a-b C d"), (6, "one two three four five six seven eight nine ten")]


def test_decontamination_counts_items_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    items = spark.createDataFrame([(None, text), (None, other), ("a", text), ("a", text)], "item_id string, text string")
    docs = spark.createDataFrame([(0, text), (1, other), (2, "nothing of it")], "doc_id long, text string")
    found = by_id(decontaminate.overlaps(docs, items))
    assert [(found[i].n_hit, list(found[i]["items"])) for i in range(3)] == [(30, ["a", None]), (30, [None]), (0, [])]
    assert [r.doc_id for r in decontaminate.keep_clean(docs, items).collect()] == [2]


def test_decontamination(spark, docs, repeated, texts, nothing):
    long = [(7, texts[6][300:700]), (8, texts[6][300:700]), (9, "same " * 20), (10, texts[12])]
    items = spark.createDataFrame([(str(i), t) for i, t in ITEMS + long], "item_id string, text string")
    found = by_id(decontaminate.overlaps(docs, items))
    want = brute.overlaps(texts, ITEMS + long)
    for i in range(len(texts)):
        assert (found[i].n_words, found[i].n_hit, list(found[i]["items"])) == want[i], i
    assert sum(n > 0 for _, n, _ in want) > 5
    twice = decontaminate.overlaps(repeated, items).collect()
    assert sorted((r.doc_id, r.n_hit) for r in twice) == sorted([(i, n) for i, (_, n, _) in enumerate(want)] * 2)
    assert decontaminate.overlaps(nothing, items).count() == 0
    none = decontaminate.overlaps(docs, items.limit(0)).collect()
    assert len(none) == len(texts) and all(r.n_hit == 0 for r in none)
    clean = decontaminate.keep_clean(docs, items)
    bad = {i for i, (n, hit, _) in enumerate(want) if hit and 20 * hit >= n}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - bad


def test_repeated_passages(docs, repeated, texts, nothing):
    found = by_id(substrings.repeats(docs, carry=["id", "source"]))
    want = brute.repeats(texts, 35)
    for i in range(len(texts)):
        assert (found[i].n_words, found[i].n_removed, found[i].kept) == want[i], i
    assert sum(n > 0 for _, n, _ in want) > 6 and found[3].source == "s1"
    twice = substrings.repeats(repeated).collect()
    assert all(r.n_removed == (r.n_words if r.n_words >= 35 else 0) for r in twice) and len(twice) == 2 * len(texts)
    assert substrings.repeats(nothing).count() == 0


@pytest.mark.parametrize("window", [4, 9])
def test_repeated_passages_of_other_lengths(docs, texts, window):
    found = by_id(substrings.repeats(docs, window=window))
    for i, want in enumerate(brute.repeats(texts, window)):
        assert (found[i].n_words, found[i].n_removed, found[i].kept) == want, i


def test_long_runs_of_names_are_read_once():
    guesser = secret_scan.Guesser.of(secret_scan.WORDS)
    start = time.perf_counter()
    for text in ("token" * 100_000, "authorization_" * 40_000 + ":", "password " * 60_000 + "=", "x" * 500_000 + "=token", "token='" * 40_000):
        secret_scan.guessed_spans(text, [], guesser, 10.0)
    assert time.perf_counter() - start < 20


def test_names_inside_longer_names():
    guesser = secret_scan.Guesser.of(secret_scan.WORDS)
    value = "Xk9#mQ2$vLpw7&"
    for text in (f"my_db_password_2 = '{value}'", f'"apiKeyOld": "{value}"', f"x-auth-token:{value}", f"a=b {value} pwd=>{value}", f"Authorization: Bearer {value}"):
        at = text.rindex(value)
        assert (at, 3, at + len(value)) in secret_scan.guessed_spans(text, [], guesser, 10.0), text

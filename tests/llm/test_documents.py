import random
import re

import numpy as np
import pytest
from gaugeworks.llm import decontaminate, pii, pii_model, pii_rules, quality

SMALL = "/root/testdata/sf0.01"


def brute_spans(text):
    """The base rules as plain patterns."""
    found = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            double = sum(int(d) if n % 2 == 0 else sum(divmod(2 * int(d), 10)) for n, d in enumerate(digits[::-1]))
            fine = {
                "email": True,
                "ip": all(int(part) < 256 for part in match[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and double % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }
            if fine[kind]:
                found.append((match.start(), match.end(), kind))
    return sorted(found, key=lambda span: (span[0], pii_rules.KINDS.index(span[2])))


def test_base_rules_are_the_patterns():
    random.seed(2)
    for n in range(6000):
        letters = "ab.@-_+%9.1 0(2)é\n" if n % 2 else "0123456789 -+.@a"
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 70)))
        assert [span[:3] for span in pii_rules.candidates(text) if span[3]] == brute_spans(text), text


def test_gradients_of_the_network():
    random = np.random.default_rng(0)
    parameters = {name: value.astype(np.float64) for name, value in pii_model.new_parameters(1).items()}
    ids, tags = random.integers(1, 90, (3, 20)), np.zeros((3, 20), int)
    tags[0, 4], tags[0, 5:9], tags[1, 7], tags[1, 8:15] = 1, 2, 5, 6
    made = pii_model.gradients(parameters, ids, tags)[1]
    for name, value in parameters.items():
        place = (int(ids[0, 5]), 3) if name == "embedding" else (1, 2) if name == "moves" else tuple(n // 2 for n in value.shape)
        ends = []
        for step in (0.01, -0.01):
            moved = dict(parameters) | {name: value.copy()}
            moved[name][place] += step
            ends.append(pii_model.gradients(moved, ids, tags)[0])
        assert made[name][place] == pytest.approx((ends[0] - ends[1]) / 0.02, rel=0.02, abs=2e-4), name


def test_best_path_and_marginals_are_those_of_all_paths():
    from itertools import product

    random = np.random.default_rng(3)
    scores, moves = random.normal(size=(4, pii_model.TAGS)), np.where(pii_model.ALLOWED, random.normal(size=(9, 9)), -1e4)
    paths = {
        path: sum(scores[t, tag] for t, tag in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
        for path in product(range(9), repeat=4)
    }
    begins = {path: value for path, value in paths.items() if path[0] == 0 or path[0] % 2}
    assert tuple(pii_model.best_tags(scores, moves)) == max(begins, key=begins.get)
    total = sum(np.exp(value) for value in paths.values())
    share = sum(np.exp(value) for path, value in paths.items() if path[2] == 3) / total
    assert pii_model.marginals(scores[None], moves)[0, 2, 3] == pytest.approx(share)


@pytest.fixture(scope="module")
def trained(spark):
    return pii.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_the_model_finds_what_rules_find_and_adds_variants(spark, trained):
    texts = [row.text for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    real = [text for text in texts if brute_spans(text)]
    found = want = 0
    for text, spans in zip(real, pii_model.decode(trained, real)):
        base = set(brute_spans(text))
        want += len(base)
        found += len(base & {span[:3] for span in spans})
    assert found >= 0.9 * want and want > 30
    both = pii.spans_of([f"{word} call (415) 555-0199 or write john.12 (at) mail7.foo.com today" for word in ("the", "and")], trained)
    assert all({span[2] for span in added} == {"phone", "email"} for _, added in both)
    clean = [text for text in texts if not pii_rules.may_hold_any(text)]
    assert all(not base and not added for base, added in pii.spans_of(clean, trained))
    assert sum(len(added) for _, added in pii.spans_of(texts, trained)) <= 2


def test_spelled_out_addresses_without_digits(trained):
    found = want = 0
    for shift in range(0, 48, 5):
        for address in ("jane.doe (at) example.com", "maria.lopez[at]company.org", "firstname.lastname (at) company-name12.com"):
            text = "word " * 8 + "w" * shift + f" write to {address} today" + " word" * 20
            at = text.index(address)
            want += 1
            found += (at, at + len(address), "email") in pii.spans_of([text], trained)[0][1]
    assert found >= 0.9 * want
    plain = ["We met at noon. Then we stayed at home (at last).", "Look at this. At the end, all is well at work."]
    assert all(not added for _, added in pii.spans_of(plain, trained))


def test_spans_do_not_depend_on_windows(trained):
    phone = "+1 (415) 555-0199"
    for shift in range(0, 60, 7):
        text = "word " * 20 + "w" * shift + " " + phone + " word" * 20
        at = text.index(phone)
        assert (at, at + len(phone), "phone") in {span[:3] for span in pii_model.decode(trained, [text])[0]}


def test_personal_data_of_odd_rows(spark, trained):
    long = "word " * 30_000 + "a.b@c.de 1.2.3.4"
    rows = [(1, None, 3), (2, "", 3), (3, "é a@b.cd", 3), (3, "é a@b.cd", 3), (None, "1.2.3.4", 3), (6, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int")
    got = sorted(map(tuple, pii.digests(pii.find(docs, trained)).select("doc_id", "n_email", "n_ip", "spans").collect()), key=repr)
    end = len(long)
    want = [(1, 0, 0, ""), (2, 0, 0, "")] + [(3, 1, 0, "email:2:8")] * 2 + [(None, 0, 1, "ip:0:7")]
    want.append((6, 1, 1, f"email:{end - 16}:{end - 8},ip:{end - 7}:{end}"))
    assert got == sorted(want, key=repr)
    redacted = pii.redact(docs, trained)
    assert redacted.columns == docs.columns
    texts = {row.doc_id: row.text for row in redacted.collect()}
    assert texts[1] is None and texts[3] == "é [EMAIL]" and texts[6].endswith("[EMAIL] [IP]")
    assert pii.find(docs.limit(0), trained).count() == 0
    assert pii.redact_text("abcdef", [(1, 4, "ip"), (3, 5, "card")]) == "a[IP]f"


def test_training_without_documents(spark):
    made = pii.fit(spark.createDataFrame([], "text string"), windows=32, rounds=1)
    assert made["out"].shape == (2 * pii_model.HIDDEN, pii_model.TAGS)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "labels"))
    scored = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [row.score for row in scored if row.quality == 1]
    bad = [row.score for row in scored if row.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([row.predicted == row.quality for row in scored]) > 0.95


def test_held_out_labels_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    one, two = (quality.score_documents(docs, some).orderBy("doc_id").collect() for some in (labels, turned))
    assert [row.score for row in one] == pytest.approx([row.score for row in two], abs=1e-9)


def test_quality_of_odd_rows(spark):
    rows = [(1, None, 1.0), (2, "", 2.0), (3, "A text.", 3.0), (3, "A text.", 3.0), (None, "B", None), (6, "long " * 100_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, None), (None, 1), (6, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.score_documents(docs, known).collect()
        assert len(got) == len(rows) and all(0 <= row.score <= 1 for row in got)
    assert {row.score for row in got} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.score_documents(docs.limit(0), labels).count() == 0


def test_pools_rise():
    x, y = np.arange(6.0), np.array([0.1, 0.3, 0.2, 0.2, 0.9, 0.8])
    centres, levels = quality.isotonic(x, y, np.ones(6))
    assert levels == pytest.approx([0.1, 0.7 / 3, 0.85]) and centres == pytest.approx([0, 2, 4.5])


def brute_score(item, passage):
    """Smith-Waterman cell by cell."""
    table, best = [[0.0] * (len(passage) + 1) for _ in range(len(item) + 1)], 0.0
    for i, a in enumerate(item):
        for j, b in enumerate(passage):
            step = table[i][j] + (1 if a == b else -decontaminate.MISMATCH)
            gap = max(table[i][j + 1], table[i + 1][j]) - decontaminate.GAP
            table[i + 1][j + 1] = max(0.0, step, gap)
            best = max(best, table[i + 1][j + 1])
    return best


def test_alignment_is_the_best_one():
    random = np.random.default_rng(5)
    for _ in range(200):
        item, passage = random.integers(0, 4, random.integers(1, 9)), random.integers(0, 4, random.integers(1, 12))
        assert decontaminate.alignment(item, passage)[0] == pytest.approx(brute_score(item, passage))


def test_copies_of_test_items(spark):
    random.seed(9)
    words = [f"w{n}" for n in range(300)]
    items = [(n, " ".join(random.choices(words, k=random.randint(3, 40)))) for n in range(25)] + [(90, None), (91, ""), (0, "w1 w2")]
    rows = [(n, " ".join(random.choices(words, k=120))) for n in range(60)]
    for n in range(40):
        copy = items[n % 25][1].split()
        if n % 2 and len(copy) > 12:
            copy[3] = "other"
            del copy[9]
        text = random.choices(words, k=50)
        rows.append((100 + n, " ".join(text[:20] + copy + text[20:]).upper()))
    # One item in very many documents: its grams are common, and are its rarest all the same.
    rows += [(1000 + n, f"{items[0][1]} {words[n % 300]} {n}") for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(row.doc_id, row.item_id): row.score for row in got}
    want = {}
    for doc_id, text in rows:
        passage = text.lower().split()
        for item_id, item in items:
            sequence = (item or "").split()
            score = brute_score(sequence, passage) / len(sequence) if len(set(sequence) & set(passage)) * 2 > len(sequence) else 0
            if score >= 0.8 and (len(sequence) >= 5 or f" {item} " in f" {text.lower()} "):
                want[doc_id, item_id] = max(score, want.get((doc_id, item_id), 0))
    assert set(found) == set(want) and len(want) > 430
    assert all(found[pair] == pytest.approx(want[pair]) for pair in want)
    sliced = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), max_words=100)
    assert {(row.doc_id, row.item_id) for row in sliced.collect()} == set(found)


def test_every_shape_of_edit_is_found(spark):
    """Words replaced, deleted or inserted at every place, and spread evenly, in items of 1 to 40 words."""
    items, rows, want = [], [], set()
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 14, 19, 25, 26, 40):
        item = [f"i{size}x{n}" for n in range(size)]
        items.append((size, " ".join(item)))
        lost = max(1, int(0.16 * size + 1e-9))
        shapes = []
        for at in range(size):
            shapes += [[*item[:at], "new", *item[at + 1 :]], [*item[:at], *item[at + 1 :]], [*item[:at], "new", *item[at:]]]
        for count in range(1, lost + 1):
            places = {round((n + 1) * size / (count + 1)) for n in range(count)}
            shapes.append(["new" if n in places else word for n, word in enumerate(item)])
            shapes.append([word for n, word in enumerate(item) if n not in places])
            shapes.append([word for n, old in enumerate(item) for word in (["new", old] if n in places else [old])])
        shapes.append([word for n, old in enumerate(item) for word in ([old, "new"] if n % 4 == 3 else [old])])
        for shape in shapes:
            number = len(rows)
            rows.append((number, f"a{number} b {' '.join(shape)} c d{number}"))
            # A word put between the two of an item of two parts its only seed.
            if brute_score(item, shape) >= 0.8 * size and (size > 2 or " ".join(item) in " ".join(shape)):
                want.add((number, size))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(row.doc_id, row.item_id) for row in found} == want and len(want) > 400


def test_copies_that_hundreds_of_documents_carry(spark):
    item = [f"q{n}" for n in range(40)]
    copy = [*item[:7], "changed", *item[8:23], "other", *item[24:]]
    spread = [word for n, word in enumerate(item) for word in ([word, "more"] if n % 8 == 7 and n < 39 else [word])]
    apart = [*item[:20], *["inserted"] * 30, *item[20:]]
    shapes = [copy, item[:34], spread, apart]
    rows = [(1000 * kind + n, f"a{n} b{n} {' '.join(shape)} c{n}") for kind, shape in enumerate(shapes) for n in range(400)]
    # Half of an item is no copy; its grams are the commonest.
    rows += [(9000 + n, f"x{n} {' '.join(item[:20])} y{n}") for n in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    for part in (docs, docs.where("doc_id < 1000 or doc_id >= 9000"), docs.where("doc_id < 9000 and doc_id >= 3000")):
        found = {row.doc_id: row for row in decontaminate.contaminated(part, benchmark).collect()}
        assert set(found) == {row.doc_id for row in part.collect() if row.doc_id < 9000}
        for row in found.values():
            assert row.score == pytest.approx(brute_score(item, shapes[row.doc_id // 1000]) / 40)
            assert (row.first_word, row.last_word) == (2, 1 + len(shapes[row.doc_id // 1000]))


def test_decontamination_of_odd_rows(spark):
    item = " ".join(f"q{n}" for n in range(12))
    rows = [(1, None, 1), (2, "", 1), (3, item, 1), (3, item, 1), (None, item, 1), (6, "x " * 100_000 + item, 1), (7, "clean", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([(5, item, 1.0)], "item_id long, text string, score double")
    found = decontaminate.contaminated(docs, benchmark).collect()
    assert sorted((row.doc_id for row in found), key=repr) == [3, 3, 6, None]
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((row.doc_id for row in kept.collect()), key=repr) == [1, 2, 7, None]
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0

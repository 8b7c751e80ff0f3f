"""Notices that are wrapped, scattered or side by side."""

import textwrap

import numpy as np

from flowloom.llm import licenses


def labels(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["labels"], [(m["label"], m["line"]) for m in r["matches"]]) for r in licenses.scan(df).orderBy("doc_id").collect()]


def test_wrapped_notices_are_found(spark):
    notices = [t for _, t in licenses.TEMPLATES]
    widths = [30, 50, 72]
    texts = ["Some words.\n\n" + "\n".join(f" * {x}" for x in textwrap.wrap(t, w)) + "\n\nMore words." for t in notices for w in widths]
    whole = [x for x, _ in labels(spark, notices)]
    assert all(label in x.split(",") for (label, _), x in zip(licenses.TEMPLATES, whole, strict=True))
    assert [x for x, _ in labels(spark, texts)] == [x for x in whole for _ in widths]


def test_scattered_words_are_no_notice(spark):
    rng = np.random.default_rng(1)
    scattered = []
    for _, t in licenses.TEMPLATES:
        words = [f"w{k}" for k in range(100 * len(licenses.words_of(t)))]
        for k, w in enumerate(licenses.words_of(t)):
            words[100 * k + int(rng.integers(0, 50))] = w.decode()
        scattered.append(" ".join(words))
    assert [x for x, _ in labels(spark, scattered)] == [""] * len(scattered)
    unbroken = " ".join(["word"] * 500) + " Released under the terms of the MIT License. " + " ".join(["word"] * 500)
    assert labels(spark, [unbroken])[0][0] == "mit"


def test_notices_side_by_side_are_all_found(spark):
    text = "Released under the BSD License. Licensed under CC BY 4.0."
    many = " ".join(["word"] * 300)
    lines = "Licensed under CC BY-SA 4.0.\nLicensed under CC BY-NC 4.0."
    nested = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
    got = labels(spark, [text, f"{many} {text} {many}", lines, nested])
    assert [x for x, _ in got] == ["bsd,cc-by", "bsd,cc-by", "cc-by-nc,cc-by-sa", "cc-by-nc"]
    assert {"cc-by", "cc-by-sa", "cc-by-nc"} == {x for x, _ in got[3][1]}


def test_every_template_at_the_threshold_is_a_match(spark):
    """Of each template all words but a tenth of the different ones: a match; one fewer: none. The same for short and long ones."""
    for _, t in licenses.TEMPLATES:
        words = [w.decode() for w in licenses.words_of(t)]
        different = sorted(set(words))
        most = len(different) - min(n for n in range(1, len(different) + 1) if n >= licenses.THRESHOLD * len(different) - 1e-9)
        for gone in (most, most + 1):
            text = " ".join(w if w not in different[:gone] else "zzz" for w in words)
            vocabulary = licenses.Vocabulary(licenses.TEMPLATES, licenses.PHRASES)
            join = licenses.Join([("own", t)], vocabulary, {})
            numbers = np.array([vocabulary.number.get(w, -1) for w in licenses.words_of(text)])
            found = join.matches(numbers, np.zeros(len(numbers), dtype=np.int64))
            assert bool(found) == (gone == most) and all(m.in_order for m in found)


def test_equal_hashes_of_other_words_are_none():
    vocabulary = licenses.Vocabulary([("x", "alpha beta gamma")], {})
    raw = np.frombuffer(b"alpha betb gamma", dtype=np.uint8)
    starts, ends = np.array([0, 6, 11]), np.array([5, 10, 16])
    vocabulary.hashes[:] = 1
    vocabulary.order[:] = vocabulary.number[b"beta"]
    real, licenses.word_hashes = licenses.word_hashes, lambda *a: np.ones(3, dtype=np.uint64)
    try:
        assert vocabulary.numbers(raw, starts, ends).tolist() == [-1, -1, -1]
    finally:
        licenses.word_hashes = real


def test_a_whole_license_is_found(spark):
    mit = "\n\n".join("\n".join(textwrap.wrap(t, 76)) for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 120)
    bsd = "\n\n".join("\n".join(textwrap.wrap(t, 76, initial_indent="* ")) for label, t in licenses.TEMPLATES if label == "bsd" and len(t) > 60)
    got = labels(spark, [f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{mit}\n", f"Copyright 1999\n\n{bsd}"])
    assert [x for x, _ in got] == ["mit", "bsd"]

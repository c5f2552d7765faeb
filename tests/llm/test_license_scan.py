import textwrap

from quarry.llm.license_scan import TEMPLATES, Scanner, scan_licenses, words_of

import messy


def names(text):
    return sorted((r[0], r[2]) for r in Scanner(TEMPLATES).scan(text))


def test_notices():
    assert names("foo\nReleased under the MIT License.\nbar") == [(1, "MIT")]
    assert names("Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.") == [(0, "CC-BY-NC-4.0"), (1, "Apache-2.0")]
    assert names("this work is licensed under the gnu general public license version 2") == [(0, "GPL-2.0")]
    assert names("Licensed under the Apache License, Version 1.1.") == []
    assert names("Licensed under CC BY-SA 4.0") == [(0, "CC-BY-SA-4.0")]
    assert names("a licence to fish") == []


def test_every_template_finds_itself():
    for name, text in TEMPLATES:
        found = list(Scanner(TEMPLATES).scan(f"Some words.\n{text}\nOther words."))
        assert name in [r[2] for r in found], text


def test_table(spark):
    data = messy.rows()
    data[3] = (4, "Released under the MIT License.", *data[3][2:])
    data[4] = data[5] = (5, "x\n" + "Released under the MIT License.\n\n\nfoo\n" * 2, *data[4][2:])
    got = sorted((r["doc_id"], r["start_line"], r["license"]) for r in scan_licenses(messy.table(spark, data)).collect())
    assert got == [(4, 0, "MIT"), *[(5, 1, "MIT")] * 2, *[(5, 5, "MIT")] * 2]
    assert scan_licenses(messy.table(spark, [])).count() == 0


MIT = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + TEMPLATES[2][1].replace("without restriction", "without restriction, including without limitation the rights to use, copy and sell copies")


def test_wrapped_texts():
    for width in (40, 70, 72, 76, 80):
        for prefix in ("", " * ", "# "):
            for name, text in TEMPLATES:
                lines = textwrap.wrap(text, width)
                wrapped = "\n".join(prefix + x for x in ["Some words.", "", *lines, "", "Other words."])
                assert (2, len(lines), name) in [r[:3] for r in Scanner(TEMPLATES).scan(wrapped)], wrapped
    assert "MIT" in [n for _, n in names("\n".join(textwrap.fill(p, 75) for p in MIT.split("\n")))]
    assert names("This is free and unencumbered software released into the public\ndomain.") == [(0, "Unlicense")]
    assert names("Permission is hereby granted, free of\n\ncharge, to any person to fish") == []


def test_short_notice_among_likely_words():
    line = "This software and the associated documentation files may be used, copied and distributed by any person, free of charge, provided that the conditions of the Free Software Foundation are met; pictures are licensed under CC BY 4.0"
    assert names(line) == [(0, "CC-BY-4.0")]
    for name, text in TEMPLATES:
        assert name in [n for _, n in names(f"{line}. {text}")]


def test_compression_ranks_the_trials():
    scanner = Scanner(TEMPLATES)
    tried = []
    aligned = scanner.alignments
    scanner.alignments = lambda k, words: tried.append(k) or aligned(k, words)
    for name, text in TEMPLATES:
        words = words_of(f"Some words. {text} Other words.")
        alone, trials = scanner.ranked(words)
        gains = [(alone - size) / scanner.own[k] for k, size in trials]
        assert gains == sorted(gains, reverse=True) and gains[0] > 0 and len(gains) == len(TEMPLATES)
        assert name in [TEMPLATES[k][0] for k, _ in trials[:3]], text
    notice = "Released under the MIT License."
    list(scanner.scan(notice))
    by_size = tried[: len(TEMPLATES)]
    assert by_size[0] == 0
    # equal sizes: the order of trials is another one
    scanner.alone = scanner.given[0]
    scanner.given = [scanner.alone] * len(TEMPLATES)
    tried.clear()
    list(scanner.scan(notice))
    assert tried[: len(TEMPLATES)] != by_size


def test_rank_decides_between_equal_wordings():
    """Two licences with one wording but for loose words: the block's own words rank them."""
    for first, second in (("by any", "for all"), ("for all", "by any")):
        pair = [(x, f"Quokka terms {x} apply here") for x in (first, second)]
        for name, text in pair:
            assert [r[2] for r in Scanner(pair).scan(text)] == [name]


def test_given_templates(spark):
    own = [("House", "Members copy these recipes freely and bring cake."), ("Loose", "for use by any")]
    df = spark.createDataFrame([(1, "Members copy these recipes\nfreely and bring cake."), (2, "for use by any"), (3, "cake")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["license"]) for r in scan_licenses(df, own).collect()) == [(1, "House"), (2, "Loose")]

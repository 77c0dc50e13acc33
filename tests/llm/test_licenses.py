import random

from strandweave.llm import licenses

SCHEMA = "id long, path string, text string, license string, dir string"
#: Fixed value: the opening of a licence.
MIT = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"


def run(spark, rows):
    out = licenses.scan(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)).collect()
    return {(r.id, r.path): (r.license, r.origin, r.from_directory) for r in out}, len(out)


def test_nearest_directory_and_own_headers(spark):
    rows = [
        (1, "a/LICENSE", MIT), (2, "a/b/x.py", "print(1)"), (3, "a/b/c/y.py", "code\n# Licensed under the Apache License, Version 2.0."), (4, "z/y.py", "nothing"), (5, "a/b/c/LICENSE", "Licensed under CC BY-NC 4.0."),
        (6, "a/b/c/d/e.py", "more"), (7, None, "more"), (8, "top.py", None), (9, "a", ""), (None, "a/n.py", "q"), (2, "a/b/x.py", "print(1)"), (10, "z/long.py", "word " * 100_000 + "\nAll rights reserved."),
    ]
    got, n = run(spark, rows)
    assert n == len(rows)
    assert got == {
        (1, "a/LICENSE"): ("MIT", "own", None), (2, "a/b/x.py"): ("MIT", "inherited", "a"), (3, "a/b/c/y.py"): ("Apache-2.0", "own", None), (4, "z/y.py"): (None, "none", None), (5, "a/b/c/LICENSE"): ("CC-BY-NC-4.0", "own", None),
        (6, "a/b/c/d/e.py"): ("CC-BY-NC-4.0", "inherited", "a/b/c"), (7, None): (None, "none", None), (8, "top.py"): (None, "none", None), (9, "a"): (None, "none", None), (None, "a/n.py"): ("MIT", "inherited", "a"),
        (10, "z/long.py"): ("Proprietary", "own", None),
    }


def test_empty_table(spark):
    assert run(spark, []) == ({}, 0)


def test_licence_lines_of_documents(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary"}
    want = {}
    for r in docs.collect():
        want[r.doc_id] = {lines[x] for x in r.text.split("\n") if x in lines}
    got = {r.id: r.license for r in licenses.scan(licenses.as_files(docs)).collect()}
    assert set(got) == set(want)
    assert all((got[i] in w) if w else got[i] is None for i, w in want.items())


def test_full_licence_files_speak_for_their_directories(spark):
    full = licenses.full_texts()
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} == set(full)
    holder = "Copyright (c) 2024 Some Holder and the Sample Project authors\n\n"
    texts = {n: holder + t for n, t in full.items()} | {"AGPL-3.0": full["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL", 1)}
    texts["GPL-3.0"] = full["GPL-3.0"] + "\n" * 10_000
    assert len(texts["GPL-3.0"]) > 40_000
    rows = [(k, f"{n}/LICENSE", t) for k, (n, t) in enumerate(texts.items())] + [(100 + k, f"{n}/src/x.py", "print(1)") for k, n in enumerate(texts)]
    prose = "All rights reserved.\n" + " ".join(full["GPL-3.0"].split()[:200]) + " and the story of the house by the sea" * 40
    rows += [(300, "prose/a.txt", prose), (301, "prose/b.txt", "print(2)")]
    got, _ = run(spark, rows)
    assert {p: g for (i, p), g in got.items() if 100 <= i < 300} == {f"{n}/src/x.py": (n, "inherited", n) for n in texts}
    assert got[(301, "prose/b.txt")] == (None, "none", None)


def test_notices_inside_paragraphs_and_texts_without_line_breaks(spark):
    prose = "the old house stood by the river and nobody went there any more because of the stories " * 8
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."}
    rows = [(k, f"{n}/a.txt", f"{prose}{x} {prose}") for k, (n, x) in enumerate(notices.items())] + [(10 + k, f"{n}/b.txt", prose * 80 + x + " " + prose * 80) for k, (n, x) in enumerate(notices.items())]
    assert len(rows[-1][2]) > 40_000
    rows += [(100, "none/a.txt", prose + "with the permission of the owner and a licence to fish " + prose)]
    got, _ = run(spark, rows)
    assert {i: g[0] for (i, _), g in got.items()} == {i: p.split("/")[0] for i, p, _ in rows if i < 100} | {100: None}


def test_inheritance_against_brute_force(spark):
    rng = random.Random(11)
    full = {n: t for n, t in licenses.full_texts().items() if n in ("MIT", "ISC", "BSD-2-Clause", "Unlicense")}
    dirs = [""] + ["/".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    files = {f"{d}/LICENSE".lstrip("/"): rng.choice(sorted(full)) for d in dirs if rng.random() < 0.3}
    rows = [(k, p, full[n]) for k, (p, n) in enumerate(files.items())] + [(1000 + k, f"{rng.choice(dirs)}/f{k}.py".lstrip("/"), "x = 1") for k in range(200)]
    got, _ = run(spark, rows)
    for i, path, _ in rows[len(files) :]:
        up = path.rpartition("/")[0]
        while f"{up}/LICENSE".lstrip("/") not in files and up:
            up = up.rpartition("/")[0]
        at = f"{up}/LICENSE".lstrip("/")
        assert got[(i, path)] == ((files[at], "inherited", up) if at in files else (None, "none", None))

from foldwise.llm.license_scan import TEMPLATES, Scanner, scan_licenses
from tests.llm.helpers import SF, awkward, empty, prose, table


def scan(text):
    return [(r["line"], r["license"], r["confirmed"]) for r in Scanner(TEMPLATES).scan(text)]


def test_every_template_is_its_own_license():
    for name, texts in TEMPLATES.items():
        for t in texts:
            assert scan(prose(20, 1) + "\n" + t + "\n" + prose(20, 2))[0] == (1, name, True)


def test_wording_and_versions():
    assert scan("This program is licensed under the Apache License, Version 2.0.") == [(0, "Apache-2.0", True)]
    rows = Scanner(TEMPLATES).scan("This work is licensed under the GNU General Public License, version 3 or so.")
    assert rows[0]["license"] == "GPL-3.0" and rows[0]["confirmed"]
    assert scan("This work is licensed under the GNU General Public License, version 2.") == [(0, "GPL-2.0", True)]
    assert scan("Licensed under the Apache License, Version 1.1.")[0][2] is False
    assert scan("He lost his driving licence on the way to the river and walked home.")[0][2] is False
    text = TEMPLATES["MIT"][1].replace(", ", ",\n")
    assert scan(text)[0][:2] == (0, "MIT") and scan(text)[0][2]
    assert scan("Released under the MIT License.\n\nReleased under the MIT License.") == [(0, "MIT", True), (2, "MIT", True)]
    assert scan(prose(3000, 1) + " Licensed under CC BY-NC 4.0. " + prose(3000, 2))[0][:2] == (0, "CC-BY-NC-4.0")


def test_given_table(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    notices = {t: n for n, texts in TEMPLATES.items() for t in texts}
    want = sorted((r.doc_id, i, notices[x]) for r in docs.collect() for i, x in enumerate(r.text.split("\n")) if x in notices)
    got = sorted((r.doc_id, r.line, r.license) for r in scan_licenses(docs).filter("confirmed").collect())
    assert want and got == want


def test_awkward_and_empty(spark):
    assert scan_licenses(awkward(spark)).count() == 0
    assert scan_licenses(empty(spark)).count() == 0
    rows = [(None, "Released under the MIT License."), (1, None), (2, "x\n" * 3000 + "Licensed under CC0 1.0."), (2, "Copyright")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.line, r.license) for r in got if r.confirmed) == [("2", 3000, "CC0-1.0"), ("None", 0, "MIT")]
    assert [(r.doc_id, r.line) for r in got if not r.confirmed] == [(2, 0)]
    assert scan_licenses(table(spark, "documents", SF)).columns[0] == "doc_id"


def test_several_notices_in_one_line():
    assert scan("Released under the MIT License. Docs licensed under CC BY 4.0.") == [(0, "MIT", True), (0, "CC-BY-4.0", True)]
    far = "Copyright 2020 by them. " + prose(900, 1) + " Licensed under the Apache License, Version 2.0. " + prose(900, 2)
    assert scan(far) == [(0, "Apache-2.0", True)]
    assert scan("Released under the MIT License. " * 3) == [(0, "MIT", True)] * 3
    assert scan("copyright x, licence y, " + prose(80, 3) + " copyright z") == [(0, scan("copyright x, licence y, "
                + prose(80, 3))[0][1], False)]
    assert scan("end...Licensed under CC BY 4.0. see--Licensed under CC0 1.0.") == [(0, "CC-BY-4.0", True), (0, "CC0-1.0", True)]


def test_wrapped_notices_keep_their_head():
    for name, text, cut in (("MPL-2.0", TEMPLATES["MPL-2.0"][1], "Public "), ("Unlicense", TEMPLATES["Unlicense"][0], "the "),
                            ("CC0-1.0", TEMPLATES["CC0-1.0"][1], "the ")):
        head, tail = text.split(cut, 1) if name != "CC0-1.0" else text.split("to the ", 1)
        wrapped = f"{head}{cut.strip() if name != 'CC0-1.0' else 'to the'}\n{tail}"
        assert scan(prose(30, 1) + "\n" + wrapped + "\n" + prose(30, 2)) == [(1, name, True)]


def test_every_template_is_tried():
    """With more templates than any number of finalists the right one is still found."""
    others = {f"X{i}": [f"Licensed under the Apache License, Version 2.0 with exception number {i}.1 of this list."] for i in range(40)}
    rows = Scanner(others | {"Apache-2.0": TEMPLATES["Apache-2.0"][:1]}).scan(
        "Licensed under the Apache License, Version 2.0. The exception number of this list is none.")
    assert [(r["license"], r["confirmed"]) for r in rows] == [("Apache-2.0", True)]

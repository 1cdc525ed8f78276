from strikelens.llm import licenses


def _found(df):
    return [(r.doc_id, r.sentence_ids, r.licenses, r.unmatched) for r in licenses.recognise(df).orderBy("doc_id").collect()]


def test_every_known_sentence_is_found_alone(frame):
    texts = [(n, s) for n, s in licenses.SENTENCES.items() if any(sign in s.lower() for sign in licenses.SIGNS)]
    assert set(licenses.SENTENCES) - {n for n, _ in texts} <= {17, 42, 53}  # these never stand first in a rule
    rows = _found(frame([(n, f"Some words before.\n{s}\nMore words after.") for n, s in texts]))
    assert [(i, ids) for i, ids, _, _ in rows] == [(n, str(n)) for n, _ in texts]
    assert all(any(sign in licenses.SENTENCES[ids[0]].lower() for sign in licenses.SIGNS) for _, ids in licenses.RULES if ids[0] < licenses.FIRST_SPDX)


def test_rules(frame):
    s = licenses.SENTENCES
    apache = f"Copyright 2020\n\n{s[5]}\n{s[6]}\n{s[7]}\n\n{s[8]}\n{s[9]}\n"
    mit = f"{s[10]} {s[11]} {s[12]}"
    rows = _found(
        frame([
            (1, apache),
            (2, f"{mit} And then: {s[3]}"),
            (3, f"{s[13]} {s[14]} {s[16]} {s[17]}"),
            (4, f"{s[18]}\n1. {s[19]}\n2. {s[20]}\n3. {s[21]}"),
            (5, f"{s[5]} One. Two. Three. {s[6]}"),
            (6, f"{s[4]} {s[4]}"),
            (7, "// licensed   under THE mit-license!!\n"),
        ])
    )
    assert [(i, names, left) for i, _, names, left in rows] == [
        (1, "Apache-2.0", 0),
        (2, "MIT,Apache-2.0", 0),
        (3, "GPL-3.0-or-later", 1),
        (4, "BSD-3-Clause", 0),
        (5, "", 2),
        (6, "MIT", 0),
        (7, "MIT", 0),
    ]
    assert rows[4][1] == "5,U,6"


def _wrapped(text, leader, width=40, end="\n"):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line = f"{line} {word}".strip()
    return end.join(f"{leader}{x}" for x in [*lines, line])


LEADERS = ["", "# ", " * ", "// ", "-- ", ";; ", "    ", "/// ", "#"]


def test_wrapped_headers_of_every_rule(frame):
    """Each rule's sentences, wrapped after 40 characters inside every kind of comment, below a copyright line."""
    rows, want = [], []
    for name, ids in licenses.RULES:
        if ids[0] >= licenses.FIRST_SPDX:
            continue
        for leader in LEADERS:
            body = _wrapped(" ".join(licenses.SENTENCES[i] for i in ids), leader)
            end = "\r\n" if leader == "// " else "\n"
            text = f"{leader}Copyright (c) 2020 Some One\n{body}\n\nint main() {{}}\n"
            rows.append((len(rows), text.replace("\n", end)))
            want.append(name)
    found = {i: names for i, _, names, _ in _found(frame(rows))}
    wrong = [(want[i], rows[i][1], found[i]) for i in range(len(rows)) if want[i] not in found[i].split(",")]
    assert not wrong, wrong[:3]


def test_sentences_wrapped_before_a_capital(frame):
    rows = _found(
        frame([
            (1, "This work is licensed under the GNU General\nPublic License, version 3."),
            (2, "/* Licensed under\n * the\n * Apache License,\n * Version 2.0. */"),
            (3, "<!-- Licensed under the MIT License. -->\n<p>text</p>"),
            (4, "A line\nLicensed under the MIT License\nAnother line"),
        ])
    )
    assert [names for _, _, names, _ in rows] == ["GPL-3.0-only", "Apache-2.0", "MIT", "MIT"]


def test_spdx_lines(frame):
    lines = ["// SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: GPL-2.0+", "/* SPDX-License-Identifier: GPL-2.0 */",
             "-- SPDX-License-Identifier: Apache-2.0\nSELECT 1", "SPDX-License-Identifier: (MIT)", "; SPDX-License-Identifier: NoSuch-1.0"]
    rows = _found(frame(list(enumerate(lines))))
    assert [names for _, _, names, _ in rows] == ["MIT", "GPL-2.0-or-later", "GPL-2.0-only", "Apache-2.0", "", ""]


def test_only_whole_sentences_count(frame):
    rows = _found(
        frame([
            (1, "They said it is not Licensed under the MIT License."),
            (2, "Licensed under the MIT License of some kind."),
            (3, "word " * 5000 + "\nmore words\n" * 2000 + "Licensed under the MIT License."),
        ])
    )
    assert [names for _, _, names, _ in rows] == ["", "", "MIT"]


def test_odd_rows(odd, empty):
    rows = _found(odd)
    assert len(rows) == 10 and all(r[1:] == ("", "", 0) for r in rows)
    assert licenses.recognise(empty).count() == 0


def test_plan_has_no_shuffle_and_no_python(odd):
    plan = licenses.recognise(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan

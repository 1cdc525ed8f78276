import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from strikelens.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    """The contract, word for word."""
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(
                    sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))
                )
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), rank, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(found)]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aZ09.%+-_@ ()\n漢1234567", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_on_long_runs_are_fast():
    assert pii.base_spans("9" * 200_000) == []
    assert pii.base_spans("a" * 200_000 + "@" + "b" * 200_000) == []
    assert len(pii.base_spans("1." * 100_000)) == 25_000
    assert pii.base_spans("1." * 2_000) == plain("1." * 2_000)


TEXTS = [
    f"word more text +1 (72{i}) 555-70{i}8 then mail{i}.x@host{i}.example.com and 10.2{i}.3.4 or 4111 1111 1111 1111 end"
    for i in range(10)
] + ["4539578763621486 in a row", "call +44 20 7946 0958 now"]


PASSAGES = [p for t in TEXTS for p in pii.passages(t)]


def test_every_rewritten_form_is_found():
    model = pii.fit(PASSAGES * 3)
    spans = {"phone": "+1 (212) 555-0187", "email": "jane.doe@mail.example.org", "card": "4111 1111 1111 1111"}
    missed = []
    for kind, span in spans.items():
        forms = pii._variants(span, kind)
        assert len(forms) >= 4
        for form in forms:
            text = f"please write to {form} today"
            if pii.all_spans(text, model) != [(16, 16 + len(form), kind)]:
                missed.append((form, pii.all_spans(text, model)))
    assert missed == []


def test_only_valid_segments_are_added():
    model = pii.fit(PASSAGES)
    for text in ("4111 1111\n1111 1112", "4111.1111.1111.1112", "300.1.2.3 and 1.2.3", "jane (at) home", "look at example.com", "we met at noon dot"):
        assert pii.all_spans(text, model) == []


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1@.-+( )[]{}<>\n\tatdo", max_size=120))
def test_regions_hold_every_mark_once(text):
    found = pii.regions(text)
    assert all(a < b for a, b, _ in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    for i, c in enumerate(text):
        if c in "01@":
            assert sum(a <= i < b for a, b, _ in found) == 1


def test_decoding_long_runs_is_fast():
    model = pii.fit(PASSAGES)
    for text in ("a" * 300_000, "a1" * 20_000, "(at)" * 20_000, " dot " * 40_000, "x at y dot " * 8_000):
        model.decode(text)


def test_the_model_adds_rewritten_forms_and_leaves_others():
    model = pii.fit(PASSAGES)
    assert ("phone",) == tuple(k for *_, k in pii.all_spans("please call (724) 555-7058 today", model))
    assert pii.all_spans("on 2024-03-04 at 10:30:00 version 1.2.3", model) == []
    for text in TEXTS:  # base spans stay, and the added ones touch none of them
        base, every = pii.base_spans(text), pii.all_spans(text, model)
        assert set(base) <= set(every)
        for s, e, _ in set(every) - set(base):
            assert all(e <= b or f <= s for b, f, _ in base)


def test_decoding_equals_all_segmentations():
    """The dynamic program against an enumeration of every set of disjoint segments."""
    model = pii.fit(PASSAGES)
    for text in ("(724) 555-7058", "+1 (724) 555 x1", "a1@b2.c 4"):
        tokens, spans = pii._candidates(text, 0, len(text))
        best = (0.0, ())

        def extend(at, score, chosen, tokens=tokens, spans=spans, text=text):
            nonlocal best
            if score > best[0]:
                best = (score, chosen)
            for i, j, s, e in spans:
                if i >= at:
                    for kind, x in enumerate(model.scores(text, s, e)):
                        extend(j, score + x, (*chosen, (s, e, pii.KINDS[kind])))

        if len(spans) <= 25:
            extend(0, 0.0, ())
            assert tuple(model.decode(text)) == best[1]


def test_digest(spark, odd, empty):
    model = pii.fit(PASSAGES)
    found = {(r.doc_id, r.n_email, r.n_ip): r for r in pii.digest(odd, model).collect()}
    assert len(pii.digest(odd, model).collect()) == 10
    nothing = hashlib.sha256(b"").hexdigest()
    assert found[2, 0, 0].base_sha256 == nothing and found[2, 0, 0].spans == ""
    at = 150_000
    assert found[6, 1, 0].base_sha256 == hashlib.sha256(f"email:{at}:{at + 17}".encode()).hexdigest()
    assert found[7, 0, 1].spans == "ip:" + ":".join(map(str, plain("漢字   é ▁ \x00 <|endoftext|> 10.0.0.1")[0][:2]))
    assert pii.digest(empty, model).count() == 0
    assert pii.fit_on(empty).decode("call 555-555-5555") == []


def test_masked_keeps_columns_and_nulls(odd):
    model = pii.fit(PASSAGES)
    out = pii.masked(odd, model)
    assert out.columns == odd.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[2] is None and texts[3] == ""
    assert texts[6].endswith("long <email>") and texts[7].endswith("<ip>")

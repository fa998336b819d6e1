import hashlib
import re

from loomwork.llm import infill

ROWS = [
    (1, "Ab c, d\nÉe"), (2, None), (3, ""), (4, "x <P> y"), (5, "a<S"), (6, "<M"), (7, "🎈🎈 ab🎈\r\n z"), (8, "word " * 60_000), (9, "a" * 300_000),
    (10, ">P<<<S>"), (None, "no id at all"), (11, "twice here"), (11, "twice here"), (2**62, "large id"), (-5, "below zero"),
    *[(k, f"<<S is {k} <P <M tail <") for k in range(20, 120)],
]


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    low, high = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    parts = ["".join(units[:low]), "".join(units[low:high]), "".join(units[high:])]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    p, m, s = parts
    output = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, form, len(p), len(m), output, text


def test_fill_in_middle_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, "f", "o") for i, t in ROWS], "doc_id long, text string, n int, form string, output string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = sorted(map(tuple, infill.digest(infill.fill_in_middle(docs)).collect()), key=repr)
    want = [brute(*r) for r in ROWS]
    assert found == sorted(((*r[:5], sha(r[5]), sha(r[6])) for r in want), key=repr)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    outputs = {(r["doc_id"], r["output"]) for r in infill.fill_in_middle(docs).collect()}
    assert outputs == {(r[0], r[5]) for r in want}
    assert infill.digest(infill.fill_in_middle(docs.limit(0))).count() == 0


def test_no_share_leaves_every_text_plain(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert infill.fill_in_middle(docs, share=0).where("form <> 'plain' OR output <> coalesce(text, '')").count() == 0

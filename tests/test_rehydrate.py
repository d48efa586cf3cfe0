import re

from textshield.operators import pii
from textshield.plans import attacks as A
from textshield.plans import catalog

BODIES = ["plain words", "card 4111 1111 1111 1111 and a.b@example.com, A.B@example.com", "call +1 555 123 4567 4111", "numbers 12 34 56 78 90 12 34 5", None, ""]


def brute(text):
    """Spans that overlap as one, each as the value of the one that wins; equal values as the last of them."""
    if text is None:
        return None
    spans, merged = sorted(pii.find(text), key=lambda s: (s.start, -s.end)), []
    for s in spans:
        if merged and s.start < merged[-1][1]:
            start, end, won = merged[-1]
            better = (pii.PRIORITY[s.kind], len(s.value)) > (pii.PRIORITY[won.kind], end - start)
            merged[-1] = (start, max(end, s.end), s._replace(start=start, end=max(end, s.end)) if better else won)
        else:
            merged.append((s.start, s.end, s))
    out, values = text, {}
    for start, end, won in reversed(merged):
        value = values.setdefault((won.kind, re.sub(r"\s+", " ", won.value.lower()).strip()), won.value)
        out = out[:start] + value + out[end:]
    return out


def test_every_row_is_redacted_and_restored(spark, tmp_path):
    rows = [(i, BODIES[i // len(A.TEXTS)]) for i in range(len(A.TEXTS) * len(BODIES))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r.doc_id: r.text for r in catalog.attacked(spark, str(tmp_path)).collect()}
    got = {r.doc_id: r.restored for r in catalog.QUERIES["pii_rehydrate"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in texts.items()} and len(got) == len(rows)
    assert any(got[i] != texts[i] for i in got)

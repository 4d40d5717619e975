"""The candidate pipeline with plug-ins that read a made audio: one letter each 200 ms, as JSON in the audio's name."""

import json

import pytest

from spanloom.operators import candidates as C
from spanloom.plans.session import ship

RATE = 1000


def timeline(text, step=200, first=1000):
    """(letter, start, end) of each letter of a text, with a pause of 300 ms at each line end."""
    out, at = [], first
    for c in text:
        if c == "\n":
            at += 300
        elif c.isalnum():
            out.append((c.lower(), at, at + step))
            at += step
    return out


def plug_in(name):
    """A recogniser or aligner: what the audio says in the window, as a track on the transcript; the audio says how it errs."""

    def call(audio, transcript, first, last):
        from spanloom.operators import tracks

        told = json.loads(audio)
        shift, confidence = told[name]
        said = [x for x in told["said"] if x[1] + min(shift, 0) >= first and x[2] + max(shift, 0) <= last]
        if not said:
            raise tracks.Unavailable
        result = {"timestamp": [[s - first + shift, e - first + shift] for _, s, e in said], "scores": [confidence] * len(said), "tokens": [c for c, *_ in said]}
        return tracks.track_of([result], transcript, "made", first=first, last=last)

    return call


def tables(spark, docs):
    """docs: (texts, marks as (paragraph, text), options: spoken, anchors, asr and force as (shift, confidence))."""
    ship(spark)
    paragraphs, highlights, audio, heard = [], [], [], {}
    for d, (texts, marks, options) in enumerate(docs):
        paragraphs += [(d, p, options.get("anchors", {}).get(p, 1000 + 1500 * p), t) for p, t in enumerate(texts)]
        for k, (p, m) in enumerate(marks):
            at = texts[p].index(m)
            highlights.append((d, p, k, at, at + len(m), m, texts[p][max(0, at - 12) : at], texts[p][at + len(m) : at + len(m) + 12]))
        heard[d] = timeline(options.get("spoken", "\n".join(texts)))
        audio.append((d, json.dumps({"said": heard[d], "asr": options.get("asr", (0, 0.95)), "force": options.get("force", (0, 0.95))}), RATE, heard[d][-1][2] + 1000))
    return (
        spark.createDataFrame(paragraphs, "doc long, paragraph long, anchor_ms long, text string"),
        spark.createDataFrame(highlights, "doc long, paragraph long, highlight long, start long, end long, text string, before string, after string"),
        spark.createDataFrame(audio, "doc long, audio string, sample_rate long, total_samples long"),
        heard,
    )


TEXTS = ["The quick brown fox jumps over it.", "A lazy dog sleeps in the warm sun, quietly.", "Nothing else was ever said about them."]


def times(said, texts, p, m):
    letters = [c for c in "".join(texts[:p] + [texts[p][: texts[p].index(m)]]) if c.isalnum()]
    n = sum(c.isalnum() for c in m)
    return said[len(letters)][1], said[len(letters) + n - 1][2]


REPEATED = [TEXTS[0], "it was so good that it was so good that it was so good that", TEXTS[2]]
CASES = {
    "clear": (TEXTS, [(0, "brown fox"), (1, "sleeps"), (2, "ever said")], {}),
    "near": (TEXTS, [(1, "sleeps"), (1, "in"), (0, "The"), (0, ".")], {"force": (60, 0.95)}),
    "far": (TEXTS, [(1, "sleeps")], {"force": (150, 0.95)}),
    "unheard": (TEXTS, [(1, "sleeps"), (2, "ever said")], {"spoken": "\n".join([TEXTS[0], TEXTS[2]])}),
    "unsure": (TEXTS, [(1, "sleeps")], {"asr": (0, 0.5)}),
    "repeated": (REPEATED, [(1, "so good")], {}),
}


@pytest.fixture(scope="module")
def judged(spark):
    paragraphs, highlights, audio, heard = tables(spark, CASES.values())
    rows = C.candidates(paragraphs, highlights, audio, plug_in("asr"), plug_in("force")).collect()
    return {name: ({(r.paragraph, r.text): r for r in rows if r.doc == d}, heard[d]) for d, name in enumerate(CASES)}


def test_clear_speech_is_approved(judged):
    got, said = judged["clear"]
    assert len(got) == 3
    for (p, m), r in got.items():
        assert (r.start, r.end) == times(said, TEXTS, p, m)
        assert (r.status, r.reasons, r.review_required) == ("auto_approved", [], False) and r.confidence >= 0.9
        assert r.left_guard <= r.start and r.right_guard >= r.end
        assert r.diagnostics.force_alignment.coverage == 1.0 and r.diagnostics.boundary_disagreement_ms == 0.0


def test_flags_and_fused_edges(judged):
    near, said = judged["near"]
    assert set(near) == {(1, "sleeps"), (1, "in"), (0, "The")}
    assert (near[1, "sleeps"].start, near[1, "sleeps"].end) == tuple(x + 30 for x in times(said, TEXTS, 1, "sleeps"))
    assert near[1, "in"].reasons == ["short_highlight"]
    assert "adjacent_character_guard_unavailable" in near[0, "The"].reasons and near[0, "The"].left_guard is None
    r = judged["far"][0][1, "sleeps"]
    # both excerpts agree, so the aligner's edges are proposed, for review
    assert r.reasons == ["boundary_disagreement_over_120ms"] and r.start == times(said, TEXTS, 1, "sleeps")[0] + 150 and r.diagnostics.boundary_disagreement_ms == 150.0


def test_unheard_paragraphs_unsure_and_repeated_words(judged):
    got, _ = judged["unheard"]
    assert "document_time_search_fallback" in got[1, "sleeps"].reasons and got[1, "sleeps"].status == "needs_review"
    assert got[2, "ever said"].status == "auto_approved"
    assert judged["unsure"][0][1, "sleeps"].reasons == ["low_model_character_confidence"]
    assert "repeated_context" in judged["repeated"][0][1, "so good"].reasons


def test_without_aligner_or_recogniser(spark):
    paragraphs, highlights, audio, heard = tables(spark, [(TEXTS, [(1, "sleeps")], {"anchors": {1: 4000, 2: 8000}})])
    (r,) = C.candidates(paragraphs, highlights, audio, plug_in("asr"), None).collect()
    assert r.reasons == ["force_aligner_unavailable"] or r.reasons == ["insufficient_coverage", "force_aligner_unavailable"]
    assert r.start == times(heard[0], TEXTS, 1, "sleeps")[0]
    (r,) = C.candidates(paragraphs, highlights, audio, None, None).collect()
    assert r.reasons == ["fallback_character_ratio", "document_time_search_fallback", "adjacent_character_guard_unavailable", "force_aligner_unavailable", "asr_aligner_unavailable"] and r.confidence == 0.07
    size, low = sum(c.isalnum() for c in TEXTS[1]), sum(c.isalnum() for c in TEXTS[1][: TEXTS[1].index("sleeps")])
    assert (r.start, r.end) == (round(4000 + 4000 * low / size), round(4000 + 4000 * (low + 6) / size))
    assert C.candidates(paragraphs.limit(0), highlights.limit(0), audio.limit(0), None, None).count() == 0

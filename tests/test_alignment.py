"""What rests on the sequence ratio, against plain Python: window search with all its passes, word matching, correction of words."""

import difflib
import os
import random
import unicodedata

import pytest

from cuelattice.functions import similarity
from cuelattice.functions.text import SYNONYMS
from cuelattice.operators import align
from cuelattice.plans import correct as plans
from cuelattice.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = "the a yes yeah ok okay river stone water light people going gonna found house Straße naïve quick brown fox jumps over lazy dog ﬁne Nº".split()


def norm(x):
    return " ".join(unicodedata.normalize("NFKC", x or "").split())


def seq(a, b):
    a, b = norm(a), norm(b)
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else float(a == b)


def core(token):
    at = [i for i, c in enumerate(token) if c.isalnum()]
    return token[at[0] : at[-1] + 1] if at else ""


def cores(x):
    return [norm(core(t)).lower() for t in x.split() if core(t)]


def alike(a, b):
    return SYNONYMS.get(a, a) == SYNONYMS.get(b, b)


def run_of(cue, window):
    best = (0, -1)
    for i in range(len(cue)):
        starts = [j for j in range(len(window)) if window[j] == cue[i]] or [j for j in range(len(window)) if alike(cue[i], window[j])]
        for j in starts:
            k = 0
            while i + k < len(cue) and j + k < len(window) and alike(cue[i + k], window[j + k]):
                k += 1
            if k > best[0]:
                best = (k, j)
    return best


def text_score(cue, window):
    a, b = ({norm(t).lower() for t in x.split()} for x in (cue, window))
    jac = len(a & b) / len(a | b) if a and b else 0.0
    ca, cb = cores(cue), cores(window)
    run, at = run_of(ca, cb)
    return jac, seq(cue, window), run, at, len(ca), len(cb)


def best_window(cue, segs):
    start, end, text = cue
    center = lambda s: (s[0] + s[1]) / 2
    mid = (start + end) / 2

    def search(width, longest):
        firsts = [i for i, s in enumerate(segs) if abs(center(s) - mid) <= width] or range(len(segs))
        best = None
        for i in firsts:
            for j in range(i + 1, min(len(segs), i + longest) + 1):
                window = " ".join(s[2] for s in segs[i:j]).strip()
                jac, ratio, run, at, n, m = text_score(text, window)
                time = max(0.0, min(segs[j - 1][1], end) - max(segs[i][0], start)) / max(1e-6, end - start)
                score = 0.8 * (0.5 * jac + 0.3 * ratio + 0.2 * run / max(1, min(n, m))) + 0.2 * time
                if best is None or score > best[4]:
                    best = (i, j, at if run else None, at + run if run else None, score)
        return best

    best, method = search(8.0, 3), "basic"
    for width, longest in ((12.0, 4), (18.0, 5), (30.0, 6)):
        if best[4] >= 0.35:
            break
        more = search(width, longest)
        if more[4] > best[4]:
            best, method = more, "expanded"
    near = min(range(len(segs)), key=lambda i: (abs(center(segs[i]) - mid), i))
    if best[4] < 0.25 and abs(center(segs[near]) - mid) <= 2.0:
        own, first = cores(text), max(0, near - 5)
        flow = [(k, w) for k in range(first, min(len(segs), near + 6)) for w in cores(segs[k][2])]
        found = (0, 0, 0.0)
        if own and flow:
            least = max(1, len(own) - 2)
            for n in range(least, max(least, min(len(flow), len(own) + 2)) + 1):
                for i in range(len(flow) - n + 1):
                    r = difflib.SequenceMatcher(None, " ".join(own), " ".join(w for _, w in flow[i : i + n])).ratio()
                    if r > found[2]:
                        found = (flow[i][0], flow[i + n - 1][0], r)
        if found[2] >= 0.4:
            return found[0], found[1] + 1, None, None, found[2], "fuzzy"
    return *best, method


@pytest.mark.parametrize("seed", range(4))
def test_best_windows(spark, seed):
    r = random.Random(seed)
    media = {}
    for m in range(6):
        at, segs = 0.0, []
        for _ in range(r.randint(3, 14)):
            length = r.uniform(0.5, 4)
            segs.append((at, at + length, " ".join(r.choice(WORDS) + r.choice(["", ",", "."]) for _ in range(r.randint(1, 9)))))
            at += length + r.choice([0, 0.3, 12.0, 25.0])
        cues = []
        for _ in range(8):
            i = r.randrange(len(segs))
            words = " ".join(s[2] for s in segs[i : i + r.choice([1, 2, 4])]).split()
            words = [w if r.random() > 0.25 else r.choice(["", "zzz", w + "x", "qq qq"]) for w in words] if r.random() < 0.6 else [r.choice(["qux", "vlim", "ooo", *WORDS[:3]]) for _ in range(r.randint(1, 5))]
            start = segs[i][0] + r.choice([-0.4, 0, 0.7, 5, 14, 40])
            cues.append((start, start + r.uniform(0.3, 4), " ".join(words)))
        media[f"m{m}"] = (cues, segs)
    c = spark.createDataFrame([(m, i, *x) for m, (cues, _) in media.items() for i, x in enumerate(cues)], "media_id string, cue_idx int, start_s double, end_s double, text string")
    s = spark.createDataFrame([(m, i, *x) for m, (_, segs) in media.items() for i, x in enumerate(segs)], "media_id string, seg_idx int, start_s double, end_s double, text string")
    got = {(x.media_id, x.cue_idx): x.match for x in align.best_windows(c, s).collect()}
    seen = set()
    for m, (cues, segs) in media.items():
        for i, cue in enumerate(cues):
            want, x = best_window(cue, segs), got[m, i]
            assert (x.i, x.j, x.token_start, x.token_end, x.method) == (*want[:4], want[5]), (m, i, cue)
            assert abs(x.score - want[4]) < 1e-9
            seen.add(want[5])
    assert {"basic", "expanded"} <= seen


def test_phrase_search_finds_words_across_segments(spark):
    segs = [("m", i, i * 1.0, i + 1.0, t) for i, t in enumerate(["completely different things here", "before it the quick", "brown fox jumps over", "lazy dogs sleep", "and more"])]
    cue = [("m", 0, 1.9, 2.0, "quik browne foxe jumpz")]
    s = spark.createDataFrame(segs, "media_id string, seg_idx int, start_s double, end_s double, text string")
    c = spark.createDataFrame(cue, "media_id string, cue_idx int, start_s double, end_s double, text string")
    x = align.best_windows(c, s).first().match
    want = best_window(cue[0][2:], [y[2:] for y in segs])
    assert (x.i, x.j, x.method) == (want[0], want[1], want[5])


def test_window_scores_and_fuzzy_best_queries(spark):
    rows = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for x in QUERIES["window_scores"](spark, SF).collect():
        jac, ratio, run, at, n, m = text_score(rows[x.conv_id, x.turn], rows[min(k for k in rows if k[0] == x.conv_id and k[1] > x.turn)])
        assert (x.run, x.run_start, x.cue_cores, x.window_cores) == (run, at, n, m)
        assert abs(x.jaccard - jac) < 1e-12 and abs(x.seq - ratio) < 1e-12
    for x in QUERIES["fuzzy_best"](spark, SF).collect():
        word = rows[x.conv_id, x.turn].split()[x.nth]
        best = ("", 0.0)
        for c in rows[min(k for k in rows if k[0] == x.conv_id and k[1] > x.turn)].split():
            v = seq(word.lower(), c.lower())
            if v > best[1]:
                best = (c, v)
        assert (x.best, round(x.score, 12)) == (best[0], round(best[1], 12))


def corrected(cue, transcript):
    """The rules, one word after another."""
    said = [core(t) for t in transcript.split() if core(t)]
    if not cue:
        return transcript
    a, b = {norm(core(t)).lower() for t in cue.split() if core(t)}, {norm(c).lower() for c in said}
    careful = (len(a & b) / len(a | b) if a and b else 0.0) < 0.10
    out, nth = [], 0
    for token in cue.split():
        c = core(token)
        lead, trail = (token.partition(c)[0], token[token.index(c) + len(c) :]) if c else (token, "")
        best = ("", 0.0)
        for s in said:
            v = seq(norm(c).lower(), norm(s).lower()) if c else 0.0
            if v > best[1]:
                best = (s, v)
        style = lambda w: w.upper() if c.isupper() else w.lower() if c.islower() else w.title() if c.istitle() else w
        if careful or not c:
            if c and said and best[1] >= 0.80:
                c = style(best[0])
            nth = min(nth + 1, len(said))
        elif any(alike(norm(c).lower(), norm(s).lower()) for s in said) or best[1] >= 0.86 or not said:
            pass
        elif best[1] >= 0.72:
            c = style(best[0])
        elif nth < len(said):
            c, nth = style(said[nth]), nth + 1
        out.append(lead + c + trail)
    return " ".join(out).strip() or transcript


def test_correction_of_words(spark):
    r = random.Random(11)
    spoil = lambda w: r.choice([w, w, w.upper(), w + "!", w[:-1], w + "s", "(" + w + ")", "xqzv", "--", w.title(), w.replace("a", "e")])
    pairs = []
    for _ in range(300):
        said = " ".join(r.choice(WORDS) for _ in range(r.randint(0, 9)))
        pairs.append((" ".join(spoil(r.choice([*said.split(), *WORDS[:4]])) for _ in range(r.randint(0, 8))), said))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, cue string, said string")
    for x in df.select("id", similarity.corrected("cue", "said").alias("x")).collect():
        assert x.x.text == corrected(*pairs[x.id]), pairs[x.id]


def test_audio_decides_unlike_cues(spark):
    s = spark.createDataFrame([("m", 0, 1.0, 2.0, "Hello world"), ("m", 1, 2.2, 3.0, "How are you")], "media_id string, seg_idx int, start_s double, end_s double, text string")
    c = spark.createDataFrame([("m", 0, 1.0, 2.0, "Hello world", "en"), ("m", 1, 2.2, 3.0, "Something else entirely", "en")], "media_id string, cue_idx int, start_s double, end_s double, text string, language string")
    plain = {x.pos: x for x in plans.correct(c, s).collect()}
    for has_audio in (False, True):
        for x in plans.correct_with_audio(c, s, has_audio=has_audio).collect():
            own, ref = plain[x.pos].text, " ".join(t for a, b, t in [(1.0, 2.0, "Hello world"), (2.2, 3.0, "How are you")] if min(b, plain[x.pos].end_s) > max(a, plain[x.pos].start_s))
            score = lambda t: 0.4 if not t else min(0.9, 0.5 + min(len(t), 60) / 200)
            want = own
            if ref and seq(own, ref) < 0.86:
                want = (own if abs(score(own) - score(ref)) <= 0.05 or score(own) > score(ref) else ref) if has_audio else ref
            assert x.text == want


def test_run_summary(spark):
    cues = spark.createDataFrame([("m", 0, 0.0, 1.0, "a", "en"), ("m", 1, 1.0, 2.0, "b", "en")], "media_id string, cue_idx int, start_s double, end_s double, text string, language string")
    done = spark.createDataFrame([("m", 0, 0.0, 1.0, "a", "aligned"), ("m", 1, 1.0, 10.5, "c", "aligned"), ("m", 1 << 40, 3.0, 4.0, "d", "generated")], "media_id string, pos long, start_s double, end_s double, text string, kind string")
    assert [tuple(x) for x in plans.run_summary(cues, done).collect()] == [("m", 2, 1, 1, 1, 1)]


def test_repositioning_from_the_command_line(spark, tmp_path):
    from cuelattice import reposition_main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHello\n")
    out = reposition_main.main(["--video", "clip_top.mp4", "--subs", str(tmp_path / "in"), "--out", "moved.srt", "--processed-dir", str(tmp_path / "out")], spark)
    from cuelattice.sources.files import read_artifact

    assert read_artifact(spark, out, "moved.srt").first().content == "1\n00:00:01,000 --> 00:00:02,000\nNOTE: position=bottom\nHello\n"
    assert read_artifact(spark, out, "other.srt").count() == 0
    reposition_main.main(["--video", "clip.mp4", "--subs", str(tmp_path / "in"), "--processed-dir", str(tmp_path / "out")], spark)
    names = os.listdir(out)
    assert len(names) == 2 and "moved.srt" in names


def test_settings():
    from cuelattice.settings import read_settings

    assert read_settings({}) == read_settings({"CORS_ALLOW_ORIGINS": "*", "DEBUG": "false"})
    got = read_settings({"CORS_ALLOW_ORIGINS": "a, b", "DEBUG": "On", "PROCESSED_DIR": "s3://x/y", "LLM_PROVIDER": "p"})
    assert (got.allowed_origins, got.debug, got.processed_dir, got.llm_provider, got.upload_dir) == (["a", "b"], True, "s3://x/y", "p", "./uploads")


def test_transcripts_are_read_from_json(spark, tmp_path):
    from cuelattice.sources.files import read_transcripts

    (tmp_path / "t.json").write_text('{"media_id": "m", "language": "en",\n "segments": [{"start": 1, "end": 2.5, "text": "Hello"}, {"start": 3.0, "text": null}]}')
    row = read_transcripts(spark, str(tmp_path)).first()
    assert (row.media_id, row.language, [tuple(x) for x in row.segments]) == ("m", "en", [(1.0, 2.5, "Hello"), (3.0, None, None)])

"""Every stage of the pipeline against plain Python, on what its predecessor kept and on the documents as they are."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from seqcomplexity.llm import bpe, linededup, mixing, quality
from seqcomplexity.llm.common import M1, M2, materialize

STAGE = dict(corpus_pipeline.STAGES)
SPACE = " \t\n\r\v\f"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def joined(sets, similar_sizes, linked):
    """Components (smallest index) of sets by links among those that share a member."""
    parent, places = list(range(len(sets))), defaultdict(list)

    def find(i):
        while parent[i] != i:
            i = parent[i] = parent[parent[i]]
        return i

    for i, own in enumerate(sets):
        met = Counter(j for x in own for j in places[x])
        for j, both in met.items():
            if similar_sizes(len(own), len(sets[j])) and linked(both, len(own) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in own:
            places[x].append(i)
    return [find(i) for i in range(len(sets))]


def near(x, y):
    return 5 * min(x, y) >= 4 * max(x, y)


def reaches(both, union):
    return 5 * both >= 4 * union


def plain_statistics(raw):
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lower, n, count = [w.lower() for w in words], max(1, len(words)), lambda these: sum(raw.count(bytes([b])) for b in these)
    upper = count(range(65, 91))
    return {
        "words": len(words), "symbols_per_word": count(b"#$%&*+/<=>@[\\]^_`{}~") / n, "upper_share": upper / max(1, upper + count(range(97, 123))), "shouts_per_word": count(b"!") / n, "bars_per_word": count(b"|") / n,
        "repeated_share": sum(a == b for a, b in zip(lower, lower[1:])) / n, "distinct_share": len(set(lower)) / n * max(1.0, math.log2(max(n, 2)) / 6),
        "short_share": sum(len(w) <= 3 and (w[:1].isalpha() or w[0] > 127) for w in words) / n, "stops_per_word": count(b".?") / n, "digit_share": count(range(48, 58)) / max(1, len(raw)),
    }


def plain_score(raw, scorer):
    """The scorer's sum over shares of hashed runs of four byte classes and over hashed bins of the statistics."""
    stats, mask = plain_statistics(raw), (1 << 64) - 1
    kind = [65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b > 127 else 48 if 48 <= b < 58 else b for b in raw]
    runs = Counter()
    for gram, n in Counter(zip(kind, kind[1:], kind[2:], kind[3:])).items():
        x = int.from_bytes(bytes(gram), "little") * int(M1) & mask
        runs[((x ^ x >> 29) * int(M2) & mask) >> 40 & quality.DIMENSIONS - 1] += n
    total = scorer.bias + sum(scorer.weights[at] * math.sqrt(n / max(1, len(raw) - 3)) for at, n in runs.items())
    for i, name in enumerate(dict.fromkeys(h[2] for h in quality.HEURISTICS)):
        few = stats["words"] < min(h[5] for h in quality.HEURISTICS if h[2] == name)
        spot = 10 if few else min(9, math.floor(10 * min(1.0, stats[name]) ** 0.5))
        total += 0.5 * scorer.weights[((i * 16 + spot + 1) * int(M2) & mask) >> 33 & quality.DIMENSIONS - 1]
    return total


def plain_lines(rows):
    """Texts without lines that are similar to an earlier one, by exact comparison of all lines; documents left without words go if they lost any."""
    rows = sorted(rows, key=lambda r: r.doc_id)
    lines = list(dict.fromkeys(x.strip(SPACE).encode() for r in rows for x in (r.text or "").split("\n") if x.strip(SPACE)))
    size = linededup.SHINGLE
    names = joined([{x[i:i + size] for i in range(len(x) - size + 1)} for x in lines], near, reaches)
    component, seen, out = dict(zip(lines, names)), set(), {}
    for r in rows:
        kept, dropped = [], 0
        for x in (r.text or "").split("\n"):
            name = component.get(x.strip(SPACE).encode())
            if name is not None and name in seen:
                dropped += 1
            else:
                kept.append(x)
                seen.add(name)
            seen.discard(None)
        text = r.text if r.text is None else "\n".join(kept)
        if not dropped or words_of(text):
            out[r.doc_id] = text
    return out


def plain_near(rows):
    """Ids of one document, the first, of each component of five-word shingle sets; documents without words stay."""
    rows = sorted(rows, key=lambda r: r.doc_id)
    sets = []
    for r in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(r.text)]
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    return {r.doc_id for r, i, name in zip(rows, range(len(rows)), joined(sets, near, reaches)) if i == name}


@pytest.fixture(scope="module")
def chain(spark):
    """What each stage gets and returns: on the documents as they are, and on what its predecessor kept."""
    docs = materialize(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "plain-docs")
    found, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, at, "unused"), "plain-stage")
        alone = out if at is docs else materialize(stage(spark, docs, "unused"), "plain-alone")
        found[name] = [(docs, alone), (at, out)]
        at = out
    return found


def test_classifier(chain):
    for before, after in chain["quality classifier"]:
        scorer = quality.fit_quality(before).scorer
        expected = {r.doc_id for r in before.collect() if plain_score((r.text or "").encode(), scorer) >= 0}
        assert {r.doc_id for r in after.collect()} == expected and 0 < len(expected) < before.count()


def test_line_dedup(chain):
    for before, after in chain["line dedup"]:
        rows = before.collect()
        expected, got = plain_lines(rows), {r.doc_id: r.text for r in after.collect()}
        assert got == expected and got != {r.doc_id: r.text for r in rows}


def test_near_duplicates(chain):
    (docs, alone), (before, after) = chain["n-gram Jaccard join"]
    expected = plain_near(docs.collect())
    assert {r.doc_id for r in alone.collect()} == expected and len(expected) < docs.count()
    assert {r.doc_id for r in after.collect()} == plain_near(before.collect())


def test_mix(chain):
    for before, after in chain["mixing sources to target weights"]:
        rows, mixed = before.collect(), after.collect()
        sizes = Counter()
        for r in rows:
            sizes[r.source] += len(words_of(r.text))
        low, high = 0.0, 1.0
        live = [n for n in sizes.values() if n]
        passes = lambda a: {s: max(n ** (1 - a) for n in live) * n ** (a - 1) for s, n in sizes.items() if n}

        def meets(a):
            weights = [n**a / sum(m**a for m in live) for n in live]
            return -sum(w * math.log(w) for w in weights) >= mixing.TARGET_ENTROPY * math.log(len(live))

        for _ in range(60):
            low, high = ((low + high) / 2, high) if meets((low + high) / 2) else (low, (low + high) / 2)
        alpha = 1.0 if meets(1.0) else low
        while max(passes(alpha).values()) > mixing.MAX_EPOCHS + 1e-4:
            alpha += 1e-4
        whole = {s: [r for r in rows if r.source == s] for s in sizes}
        for source, size in sizes.items():
            visits = Counter(r.doc_id for r in mixed if r.source == source)
            assert set(visits) == {r.doc_id for r in whole[source]} and max(visits.values()) - min(visits.values()) <= 1
            spent, budget = sum(len(words_of(r.text)) for r in mixed if r.source == source), passes(alpha).get(source, 1) * size
            longest = max(len(words_of(r.text)) for r in whole[source])
            assert size <= spent <= budget * 1.001 + 1 and spent >= budget * 0.999 - longest - 1
        texts = {r.doc_id: r.text for r in rows}
        assert all(r.text == texts[r.doc_id] for r in mixed)


def test_encoding(chain):
    library = Tokenizer.from_file(str(bpe.tokenizer_path()))
    for before, after in chain["BPE encoding and decoding"]:
        texts = {r.doc_id: r.text or "" for r in before.collect()}
        got = after.collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in before.collect())
        for r in got:
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids) and r.n_tokens == len(ids)
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

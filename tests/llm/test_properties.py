"""Properties that need no session: signatures never miss, cuts never change ids, permutations invert."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tracklode.llm import privacy, setjoin, tokens


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=70), st.integers(0, 10**6), st.sampled_from([0.5, 0.6, 0.8]))
def test_similar_sets_share_a_signature(a, seed, threshold):
    r = random.Random(seed)
    b = set(a)
    for _ in range(r.randint(0, max(1, len(a)))):  # add and drop while still similar
        c = b ^ {r.randrange(400)}
        if c and len(a & c) / len(a | c) >= threshold:
            b = c
    shares = {t: 1 / (t + 1.5) for t in range(60)}
    make = setjoin.Signatures(threshold, shares)
    small, large = sorted((sorted(a), sorted(b)), key=len)
    assert set(make.probes(small)) & set(make.indexed(large))
    if len(a) == len(b):
        assert set(make.probes(large)) & set(make.indexed(small))
    x, y = (sum(1 << i for i in range(128) if sum(((t * 0x9E3779B97F4A7C15 >> 20) & 127) == i for t in s) % 2) for s in (a, b))
    assert bin(x ^ y).count("1") <= len(a ^ b) <= len(a) + len(b) - 2 * setjoin.least_overlap(threshold, len(a) + len(b))


def test_bands_cover_all_sizes():
    last = 0
    while last < 2000:
        lo, hi = setjoin.band_of(last + 1)
        assert lo == last + 1 and hi >= lo and setjoin.band_of(hi) == (lo, hi) and hi <= max(lo, math.floor(lo * 1.15))
        last = hi


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 1.'\n\t\rsé à²　😀§½—\x85\x1c")), max_size=40))
def test_cuts_never_change_the_ids(text):
    f = tokens.fragments(tokens.VOCAB_DIR)
    pieces = f.split(text)
    assert "".join(pieces) == text
    assert b"".join(f[p] for p in pieces) == b"".join(i.to_bytes(4, "little") for i in f.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789ABab +-/().", max_size=24), st.binary(min_size=1, max_size=32))
def test_format_stays(s, key):
    p = privacy.permute_text(s, key)
    assert [c.isdigit() for c in p] == [c.isdigit() for c in s] and [c.isalpha() and c.isupper() for c in p] == [c.isalpha() and c.isupper() for c in s]
    assert privacy.permute_text(p, key, back=True) == s


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_spans_lie_in_the_text(text):
    f = privacy.Finder([("Brenan", "given"), ("Fenholt", "family")])
    flat = privacy.flatten(text)
    end = 0
    for a, z, kind in f.find(flat):
        assert end <= a < z <= len(flat) and kind in ("EMAIL", "PHONE", "IDNUM", "ADDRESS", "NAME")
        end = z

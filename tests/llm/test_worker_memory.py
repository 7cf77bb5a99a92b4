"""What a Python worker keeps between the stages of the pipeline."""
import re
from pathlib import Path

import pyarrow as pa
import pytest

from ledgerscope.llm import common, op6_packing, tokens


def held_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_freed_memory_goes_back_to_the_system():
    common.release()
    before = held_mb()
    kept = [b"x" * (100_000 + i % 7) for i in range(3000)]  # below the size from which malloc maps pages of their own
    last = b"x" * 100_000  # lies above them, so the heap cannot simply shrink
    assert held_mb() > before + 250
    del kept
    common.release()
    assert held_mb() < before + 60 and len(last)


def test_packing_encodes_groups_below_its_bound(monkeypatch):
    pytest.importorskip("tokenizers")
    enc = tokens.encoder(op6_packing.word_tokenizer(), True)
    texts = pa.array([f"word{i} and, more of it " * 200 for i in range(1000)] + [None, "", "a\n\nb"])
    whole, sizes, group = list(enc.encode_all(texts)), [], enc._group
    monkeypatch.setattr(enc, "_group", lambda part: sizes.append(part.nbytes) or group(part))
    assert list(enc.encode_all(texts, op6_packing._GROUP_BYTES)) == whole
    assert len(sizes) > 2 and max(sizes) < 1.1 * op6_packing._GROUP_BYTES

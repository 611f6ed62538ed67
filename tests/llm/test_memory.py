"""What Python workers keep between tasks."""

import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from skyloom.llm import toxicity

ROOT = Path(__file__).resolve().parents[2]
HELD = """
import re, sys
import numpy as np, pyarrow as pa
from skyloom.llm.scratch import freeing

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10

def work(batches):
    for batch in batches:  # many blocks that are freed and a few above them that stay
        some = [np.ones(4096) for _ in range(6000)]
        stay.append(some[::500])
        yield batch
        del some

stay, before = [], held()
for _ in (freeing(work) if sys.argv[1] == "freeing" else work)(iter([pa.RecordBatch.from_arrays([pa.array([1])], ["a"])])):
    pass
print(held() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc and needs the GNU C library")
def test_a_task_gives_back_what_it_no_longer_uses():
    mb = {how: int(subprocess.run([sys.executable, "-c", HELD, how], cwd=ROOT, capture_output=True, text=True, check=True, timeout=60).stdout) for how in ("plain", "freeing")}
    assert mb["plain"] > 100 and mb["freeing"] < 30, mb


def test_operators_of_the_pipeline_give_memory_back():
    """Each Arrow function of the stages that read texts ends with it."""
    for name in ("toxicity", "tokens", "neardup", "decontam", "pseudonyms"):
        source = (ROOT / f"skyloom/llm/{name}.py").read_text()
        calls = re.findall(r"mapInArrow\((\w+)", source)
        assert calls and set(calls) <= {"freeing", "fill"}, (name, calls)  # fill holds a part of a bit filter, no text


def test_the_index_takes_the_postings_place():
    """A worker holds the index of the examples or their postings, not both, and finds the same with it."""
    hashes = np.unique(np.concatenate([toxicity.term_counts([t])[1] for t in ("one bad text", "one good text")]))
    terms = toxicity.Terms(hashes, np.ones(len(hashes)), 1.0)
    row, term, w = terms.vectors(["one bad text", "one good text"])
    model = toxicity.Examples(terms, np.array([7, 8]), np.array([1, 0]), np.ones(2), 0.5, (row, term, w))
    score, ids, cosine = model.score(["one bad text", "one good text", None])
    assert model.postings is None and ids[:, 0].tolist() == [7, 8, -1] and cosine[:2, 0].tolist() == [1, 1]
    assert [x.tolist() for x in model.score(["one bad text", "one good text", None])] == [score.tolist(), ids.tolist(), cosine.tolist()]

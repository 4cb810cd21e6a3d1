"""What a worker keeps between tasks."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
from causeway.llm import _shared, _words
_shared.settle("a")
first = _shared.keep("k", object)
_words.powers(_words.BASE, 10)
_shared.settle("a")
assert _shared.keep("k", object) is first and _words._POWERS
_shared.settle("b")
assert not _words._POWERS and _shared.keep("k", object) is not first
assert _words.powers(_words.BASE, 3).tolist() == [1, _words.BASE, _words.BASE**2 % 2**64]
"""


def test_state_goes_when_another_operator_starts():
    subprocess.run([sys.executable, "-c", SCRIPT], check=True, timeout=60, cwd=Path(__file__).parents[2])

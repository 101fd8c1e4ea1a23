import pytest

pytest.importorskip("tarnlake.llm.scratch")

"""Workers hand back what their batches freed."""

from tonewheel.llm import lean


def test_memory_goes_back_after_each_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(lean, "give_back", lambda: calls.append(1))
    assert lean.lean(lambda a, b: a + b)(1, 2) == 3 and len(calls) == 1
    doubled = lean.lean_batches(lambda batches: (2 * b for b in batches))(iter([1, 2]))
    assert next(doubled) == 2 and len(calls) == 1
    assert list(doubled) == [4] and len(calls) == 4


def test_giving_back_is_allowed_anywhere():
    lean.give_back()

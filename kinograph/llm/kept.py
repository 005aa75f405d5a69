"""What a Python worker keeps between tasks: one thing at a time.

Workers serve all operators of a session one after another, so what one has
learnt (words and their ids, or their likelihoods) is let go when another starts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_things: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """The thing of this key, made if it isn't there; any other is let go."""
    if key not in _things:
        _things.clear()
        _things[key] = make()
    return _things[key]


def nothing() -> None:
    """Let go of everything."""
    _things.clear()

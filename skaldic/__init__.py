"""A PySpark-native engine for scoring transcriptions and publishing leaderboards."""

from importlib import import_module

_HOME = {
    "normalise": "functions.text",
    "normalize": "functions.text",
    "normalize_numbers_da": "functions.text",
    "strip_number_separators": "functions.text",
    "compute_wer": "operators.scoring",
    "compute_cer": "operators.scoring",
}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    """Loaded when asked for: Python workers import the package, and few need these."""
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)

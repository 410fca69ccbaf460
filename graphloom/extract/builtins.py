"""Names that each language gives without an import."""

from __future__ import annotations

# Calls of these names are not references to the repository.
_SCRIPT = "console JSON Object Array Math Promise String Number Boolean Symbol Date RegExp Error Map Set WeakMap WeakSet parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent require module exports globalThis window document setTimeout setInterval clearTimeout clearInterval fetch this undefined null NaN Infinity"
NAMES = {
    "python": (
        "abs all any ascii bin bool breakpoint bytearray bytes callable chr classmethod compile complex delattr dict dir divmod enumerate eval exec filter float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len list locals map max memoryview min next object oct open ord pow print property range repr reversed round set setattr slice sorted staticmethod str sum super tuple type vars zip __import__ self cls "
        "Exception BaseException ValueError TypeError KeyError IndexError AttributeError RuntimeError StopIteration OSError NotImplementedError NotImplemented Ellipsis None True False"
    ),
    "javascript": _SCRIPT,
    "typescript": _SCRIPT + " Partial Record Pick Omit",
    "tsx": _SCRIPT + " Partial Record Pick Omit",
    "go": "make len cap append panic recover new delete copy close print println complex real imag int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 string bool byte rune error any nil true false iota min max clear",
    "java": "System String Integer Long Double Float Boolean Character Object Math Thread Exception RuntimeException IllegalArgumentException NullPointerException List Map Set ArrayList HashMap HashSet Optional Stream StringBuilder Objects Arrays Collections this super null true false",
    "c_sharp": "Console String Int32 Int64 Double Boolean Object Math Task List Dictionary IEnumerable Exception this base null true false var",
    "rust": "println print format vec panic assert assert_eq Some None Ok Err String Vec Box Option Result self Self std core alloc",
    "ruby": "puts print require attr_accessor attr_reader attr_writer new self nil true false raise",
    "php": "echo print isset unset empty array list new clone self parent static null true false",
}


def builtin_table(spark):
    """language and name: a few hundred fixed rows."""
    return spark.createDataFrame([(language, name) for language, names in NAMES.items() for name in names.split()], "language string, name string")

"""Words and file extensions of the languages that the token operators know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Keywords by language, as archives of this format classify them.
_JS = """abstract as async await break case catch class const constructor continue debugger declare default delete do else enum export
extends false finally for from function get if implements import in instanceof interface let module namespace new null of package private
protected public readonly require return set static super switch this throw true try type typeof var void while with yield"""
_TS_ONLY = "infer is keyof out override satisfies unique using"
_C = """_Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local alignas alignof auto bool break case
char const continue default do double else enum extern false float for goto if inline int long nullptr register restrict return short signed
sizeof static static_assert struct switch thread_local true typedef typeof union unsigned void volatile while"""
_CPP_ONLY = """catch class co_await co_return co_yield concept consteval constexpr constinit decltype delete explicit export final friend mutable
namespace new noexcept operator override private protected public requires template this throw try typename using virtual"""
_JAVA = """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto
if implements import instanceof int interface long native new non-sealed package permits private protected public record return sealed short
static strictfp super switch synchronized this throw throws transient try var void volatile while yield"""
_CSHARP = """abstract add alias as ascending base bool break byte case catch char checked class const continue decimal default delegate descending do
double dynamic else enum event explicit extern false file finally fixed float for foreach from get global goto group if implicit in init int
interface internal into is join let lock long nameof namespace new null object operator orderby out override params partial private protected
public readonly record ref remove required return sbyte scoped sealed select set short sizeof stackalloc static string struct switch this throw
true try typeof uint ulong unchecked unsafe ushort using value var virtual void volatile when where while yield"""
_GO = """break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select
struct switch type var"""
_RUST = """Self abstract as async await become box break const continue crate do dyn else enum extern false final fn for gen if impl in let loop
macro match mod move mut override priv pub raw ref return self static struct super trait true try type typeof union unsafe unsized use virtual
where while yield"""
_SWIFT = """Any Protocol Self Type as associatedtype break case catch class continue convenience default defer deinit didSet discardableResult do
dynamic else enum extension fallthrough false final for func guard if import in indirect init inout internal is lazy let mutating nil nonmutating
open operator optional override postfix prefix private protocol public repeat required rethrows return self static struct subscript super switch
throw throws true try typealias unowned var weak where while willSet"""
_KOTLIN = """actual annotation as as? break by catch class companion const constructor continue crossinline data delegate do dynamic else enum expect
external false field file finally for fun get if import in infix init inline inner interface internal is it lateinit noinline null object open
operator out override package param private property protected public receiver reified return sealed set setparam super suspend tailrec this
throw true try typealias typeof val value var vararg when where while"""
_PHP = """__halt_compiler abstract and array as break callable case catch class clone const continue declare default die do echo else elseif empty
enddeclare endfor endforeach endif endswitch endwhile eval exit extends false final finally fn for foreach from function global goto if implements
include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require
require_once return static switch throw trait true try unset use var while xor yield"""
_RUBY = """BEGIN END __ENCODING__ __FILE__ __LINE__ alias and begin break case class def defined? do else elsif end ensure false for if in module
next nil not or redo rescue retry return self super then trace_var true undef unless until untrace_var when while yield"""
_SQL = """ALL ALTER AND AS ASC AUTO_INCREMENT AVG BETWEEN BY CASCADE CASE CAST CHECK COMMIT CONSTRAINT CONVERT COUNT CREATE DATABASE DEFAULT DELETE
DENSE_RANK DESC DESCRIBE DISTINCT DROP ELSE END EXISTS EXPLAIN FOREIGN FROM FUNCTION GRANT GROUP HAVING IF IN INDEX INNER INSERT INTO IS JOIN KEY
LEFT LIKE LIMIT MAX MIN NOT NULL OFFSET ON OR ORDER OUTER PARTITION PRIMARY PROCEDURE RANK RECURSIVE REFERENCES RESTRICT RETURNING REVOKE RIGHT
ROLLBACK ROW_NUMBER SAVEPOINT SELECT SET SHOW SUM TABLE THEN TRANSACTION TRIGGER UNION UNIQUE UPDATE USE VALUES VIEW WHEN WHERE WINDOW WITH"""
_BASH = """[ [[ alias break case cd continue coproc declare dirs do done echo elif else esac eval exec exit export false fi for function getopts
hash if in local popd printf pushd pwd read readonly return select set shift shopt source test then time trap true typeset unalias unset until
wait while"""
_PYTHON = """False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda
nonlocal not or pass raise return try while with yield"""
# Names that JavaScript and TypeScript programs find defined.
_JS_BUILTINS = """Array Boolean Buffer Date Error Function Infinity JSON Map Math NaN Number Object Promise Proxy RangeError ReferenceError Reflect RegExp
Set String Symbol SyntaxError TypeError WeakMap WeakSet __dirname __filename addEventListener arguments cancelAnimationFrame clearInterval
clearTimeout console decodeURI decodeURIComponent dispatchEvent document encodeURI encodeURIComponent eval exports fetch global history
isFinite isNaN localStorage location module navigator parseFloat parseInt process removeEventListener requestAnimationFrame require
sessionStorage setInterval setTimeout undefined window"""
# Python's built-in names, frozen so that archives don't depend on the interpreter.
_PYTHON_BUILTINS = """ArithmeticError AssertionError AttributeError BaseException BaseExceptionGroup BlockingIOError BrokenPipeError BufferError
BytesWarning ChildProcessError ConnectionAbortedError ConnectionError ConnectionRefusedError ConnectionResetError DeprecationWarning EOFError
Ellipsis EncodingWarning EnvironmentError Exception ExceptionGroup FileExistsError FileNotFoundError FloatingPointError FutureWarning
GeneratorExit IOError ImportError ImportWarning IndentationError IndexError InterruptedError IsADirectoryError KeyError KeyboardInterrupt
LookupError MemoryError ModuleNotFoundError NameError NotADirectoryError NotImplemented NotImplementedError OSError OverflowError
PendingDeprecationWarning PermissionError ProcessLookupError PythonFinalizationError RecursionError ReferenceError ResourceWarning RuntimeError
RuntimeWarning StopAsyncIteration StopIteration SyntaxError SyntaxWarning SystemError SystemExit TabError TimeoutError TypeError
UnboundLocalError UnicodeDecodeError UnicodeEncodeError UnicodeError UnicodeTranslateError UnicodeWarning UserWarning ValueError Warning
ZeroDivisionError __build_class__ __debug__ __doc__ __import__ __loader__ __name__ __package__ __spec__ abs aiter all anext any ascii bin bool
breakpoint bytearray bytes callable chr classmethod compile complex copyright credits delattr dict dir divmod enumerate eval exec exit filter
float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len license list locals map max memoryview
min next object oct open ord pow print property quit range repr reversed round set setattr slice sorted staticmethod str sum super tuple type
vars zip"""
# Extensions by language.
_EXTENSIONS = {
    "js": ".js .jsx .mjs .cjs",
    "ts": ".ts .tsx .mts .cts",
    "c": ".c .h",
    "cpp": ".cpp .cc .cxx .hpp .hh",
    "java": ".java",
    "csharp": ".cs",
    "go": ".go",
    "rust": ".rs",
    "swift": ".swift",
    "kotlin": ".kt .kts",
    "php": ".php",
    "ruby": ".rb .rake",
    "sql": ".sql",
    "bash": ".sh .bash .zsh",
}

KEYWORDS = {
    "js": _JS, "ts": f"{_JS} {_TS_ONLY}", "c": _C, "cpp": f"{_C} {_CPP_ONLY}", "java": _JAVA, "csharp": _CSHARP, "go": _GO, "rust": _RUST, "swift": _SWIFT,
    "kotlin": _KOTLIN, "php": _PHP, "ruby": _RUBY, "sql": _SQL, "bash": _BASH, "python": _PYTHON,
}
KEYWORDS = {lang: frozenset(words.split()) for lang, words in KEYWORDS.items()}
BUILTINS = {"js": frozenset(_JS_BUILTINS.split()), "ts": frozenset(_JS_BUILTINS.split()), "python": frozenset(_PYTHON_BUILTINS.split())}
LANGUAGE_OF = {ext: lang for lang, exts in _EXTENSIONS.items() for ext in exts.split()}
CODE_EXTENSIONS = frozenset(LANGUAGE_OF)
SUPPORTED = CODE_EXTENSIONS | {".py", ".svg", ".png"}


def detect_language(name: str) -> tuple[str, frozenset, frozenset] | tuple[None, None, None]:
    """(extension, keywords, builtins) of a file name's language; Nones for other files."""
    base = name.rsplit("/", 1)[-1]
    ext = "." + base.rpartition(".")[2].lower() if "." in base[1:] else ""
    if ext not in LANGUAGE_OF:
        return None, None, None
    lang = LANGUAGE_OF[ext]
    return ext, KEYWORDS[lang], BUILTINS.get(lang, frozenset())


def ext_lang(spark: SparkSession) -> DataFrame:
    """(ext, lang), one row for each code extension and .py; a few dozen rows."""
    return spark.createDataFrame(sorted({**LANGUAGE_OF, ".py": "python"}.items()), "ext string, lang string")


def lexicon(spark: SparkSession) -> DataFrame:
    """(lang, cls, token) with cls kw or bi; about 1,200 rows."""
    rows = [(lang, cls, w) for cls, of in (("kw", KEYWORDS), ("bi", BUILTINS)) for lang, words in of.items() for w in sorted(words)]
    return spark.createDataFrame(rows, "lang string, cls string, token string")

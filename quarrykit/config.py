"""Parameters and word lists of indexing and retrieval."""

from __future__ import annotations

from dataclasses import dataclass, field

# The lists below must be these for results to be comparable with existing indexes.
CODE_STOPWORDS = (
    "const let var function return if else import export from default new this typeof await async class extends true false null undefined of in for"
    " while try catch throw switch case break continue void interface type implements public private protected readonly static as is do yield delete"
    " instanceof"
).split()
ENGLISH_STOPWORDS = (
    "the an and or to it its be by on at with that are was not no but so if we you can will has have had any all may also than then when which who"
    " into out"
).split()
QUESTION_WORDS = (
    "where what how which who why does do did is are was were the this that these those a an of in on for to and or it its i me my we can could should"
    " would there here with from by at as be been being about any some all get gets show find tell explain implemented implementation implement defined"
    " defines define handled handles handle happen happens file files code function functions module modules used uses use using work works when then"
    " after before called calls call support supports responsible"
).split()
ENTRY_TERMS = "entry point entrypoint main bootstrap startup start cli command line bin".split()
VENDORED_DIRS = (
    "node_modules vendor vendors third_party third-party dist build out .next .nuxt coverage .git .yarn .pnpm-store bower_components __pycache__ .turbo .cache"
).split()
LOCKFILES = "package-lock.json yarn.lock pnpm-lock.yaml npm-shrinkwrap.json bun.lockb bun.lock composer.lock Cargo.lock".split()
BINARY_EXTENSIONS = (
    "png jpg jpeg gif webp ico bmp svgz pdf zip gz tgz tar 7z rar woff woff2 ttf otf eot mp3 mp4 mov wav ogg webm wasm so dll exe dylib class jar node bin psd ai"
).split()
LANGUAGE_EXTENSIONS = {
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "mts", "cts"],
    "tsx": ["tsx"],
    "markdown": ["md", "mdx"],
}
CONFIG_FILES = "package.json tsconfig.json jsconfig.json nx.json turbo.json vercel.json deno.json jsr.json lerna.json".split()
TEST_DIRS = "test tests __tests__ __mocks__ __fixtures__ spec specs e2e fixtures fixture test-d test-helpers __snapshots__".split()
EXAMPLE_DIRS = "examples example demo demos playground playgrounds samples sample benchmarks benchmark bench scripts".split()
DOCS_DIRS = "docs doc dev-docs documentation".split()
NON_SOURCE_WORDS = "test tests spec specs example examples demo demos sample samples doc docs documentation readme guide tutorial template".split()
RESOLVE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"]
JS_TO_TS = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}
BUILD_DIRS = ["dist", "build", "out", "distribution", "esm", "cjs", "lib"]
SOURCE_DIRS = ["src", "source", "lib"]
ASSET_EXTENSIONS = "css scss sass less svg png jpg jpeg gif json md html txt wasm node woff woff2".split()
# Modules that come with Node.js.
BUILTINS = (
    "assert assert/strict async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns dns/promises domain events fs"
    " fs/promises http http2 https inspector inspector/promises module net os path path/posix path/win32 perf_hooks process punycode querystring readline"
    " readline/promises repl stream stream/consumers stream/promises stream/web string_decoder sys timers timers/promises tls trace_events tty url util"
    " util/types v8 vm wasi worker_threads zlib"
).split()
# Targets that are no entry.  The dots match any character, as in the indexes to be compared with.
NO_ENTRY = r".d.[cm]?ts$|.(css|json|map)$"
MAX_PATH, MAX_TERM = 400, 40
MAX_CHUNK_LINES, MIN_CHUNK_LINES, WINDOW_LINES = 80, 15, 50


@dataclass(frozen=True)
class IndexConfig:
    """How an index is built; a query must use the stemming its index was built with."""

    verb_stemming: bool = False
    include_config: bool = True
    resolve_aliases: bool = True


@dataclass(frozen=True)
class SearchOptions:
    """Switches and weights of retrieval."""

    k: int = 10
    symbols: bool = True
    paths: bool = True
    import_expansion: bool = True
    entry_boost: bool = True
    class_weights: dict[str, float] = field(default_factory=lambda: {"test": 0.3, "example": 0.3, "docs": 0.3})
    k1: float = 1.2
    b: float = 0.75
    symbol_weight: float = 0.6
    path_weight: float = 0.5
    entry_weight: float = 1.2
    entry_base: float = 0.35
    import_decay: float = 0.25
    import_seeds: int = 3
    max_neighbours: int = 20
    path_files: int = 10
    per_file: int = 3


@dataclass(frozen=True)
class Policy:
    """Thresholds of idf coverage for declining and for caution."""

    low: float = 0.3
    high: float = 0.5

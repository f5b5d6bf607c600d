"""Languages, media types and what source scans leave out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: extensions by language
LANGUAGES = {
    "go": "go", "rust": "rs", "python": "py pyw", "javascript": "js mjs cjs jsx", "typescript": "ts mts cts tsx", "c": "c h", "cpp": "cpp hpp cc cxx hh", "csharp": "cs", "java": "java",
    "kotlin": "kt kts", "scala": "scala", "swift": "swift", "objc": "m", "objcpp": "mm", "ruby": "rb", "php": "php", "shell": "sh bash zsh", "powershell": "ps1 psm1", "batch": "bat cmd",
    "html": "html htm", "css": "css", "scss": "scss", "sass": "sass", "less": "less", "vue": "vue", "svelte": "svelte", "json": "json", "yaml": "yaml yml", "toml": "toml", "xml": "xml",
    "sql": "sql", "graphql": "graphql gql", "protobuf": "proto", "zig": "zig", "lua": "lua", "dart": "dart", "r": "r", "julia": "jl", "elixir": "ex exs", "erlang": "erl hrl",
    "clojure": "clj cljs", "haskell": "hs lhs", "ocaml": "ml mli", "nix": "nix",
}
EXTENSIONS = {e: language for language, es in LANGUAGES.items() for e in es.split()}
IMAGE_EXTENSIONS = "png jpg jpeg webp gif bmp tiff tif svg".split()
DOCUMENT_EXTENSIONS = "docx doc odt xlsx xls ods pptx ppt odp epub tex html htm xml csv tsv json yaml yml ipynb bib ris eml msg dbf rtf rst txt".split()
IGNORED_FOLDERS = ".git .svn .hg node_modules vendor bower_components target dist build bin obj out .next .nuxt __pycache__ .venv venv env .pytest_cache .mypy_cache .idea .vscode .zed .vs .terraform .serverless coverage .turbo".split()
IGNORED_FILES = "package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock go.sum composer.lock Gemfile.lock poetry.lock mix.lock .DS_Store Thumbs.db".split()
IGNORED_ENDINGS = ".min.js .min.css .map .bundle.js".split()
MEDIA_TYPES = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg"}


def extension(path: Column) -> Column:
    """In lower case, without the dot; empty if the name has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def language_of(path: Column) -> Column:
    """The language of a source file by its extension, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), extension(path))


def media_extension(media_type: Column) -> Column:
    """The extension to save a media type under; 'bin' for an unknown one."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), F.lower(media_type)), F.lit("bin"))


def media_type_of(path: Column) -> Column:
    """The media type of an image by its extension; image/png for an unknown one."""
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), extension(path)), F.lit("image/png"))


def data_uri(media_type: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.base64(data))


def data_uri_parts(uri: Column) -> Column:
    """struct(media_type, data) of a data URI, null if it is none; padding may be missing."""
    pattern = r"(?s)^data:([^;,]*);base64,(.*)$"
    body = F.regexp_replace(F.regexp_extract(uri, pattern, 2), r"[\s=]", "")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "=")
    return F.when(uri.rlike(pattern), F.struct(F.regexp_extract(uri, pattern, 1).alias("media_type"), F.try_to_binary(padded, F.lit("base64")).alias("data")))


def line_count(text: Column) -> Column:
    """Line ends plus one; 0 for null."""
    return F.coalesce(F.size(F.split(text, "\n")), F.lit(0))

"""One-line descriptions of files by pattern, as columns. Java patterns carry (?U) for Unicode words, (?d) for \\n lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of well-known file names.
KNOWN_FILES = {
    "package.json": "npm package manifest",
    "package-lock.json": "npm dependency lock",
    "tsconfig.json": "TypeScript compiler configuration",
    "tsconfig.build.json": "TypeScript build configuration",
    **dict.fromkeys((".eslintrc.json", ".eslintrc.js", ".eslintrc.cjs", "eslint.config.js", "eslint.config.mjs"), "ESLint configuration"),
    **dict.fromkeys((".prettierrc", ".prettierrc.json", "prettier.config.js"), "Prettier configuration"),
    "Cargo.toml": "Rust package manifest",
    "Cargo.lock": "Rust dependency lock",
    **dict.fromkeys(("Dockerfile", "Dockerfile.dev", "Dockerfile.prod"), "Container build instructions"),
    **dict.fromkeys(("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"), "Docker Compose service definitions"),
    "Makefile": "Make build recipes",
    **dict.fromkeys(("Justfile", "justfile"), "Just command recipes"),
    ".gitignore": "Git ignore patterns",
    ".gitattributes": "Git attributes",
    ".editorconfig": "Editor configuration",
    **dict.fromkeys(("jest.config.ts", "jest.config.js"), "Jest test configuration"),
    **dict.fromkeys(("vitest.config.ts", "vitest.config.js"), "Vitest configuration"),
    **dict.fromkeys(("webpack.config.js", "webpack.config.ts"), "Webpack bundler configuration"),
    **dict.fromkeys(("vite.config.ts", "vite.config.js"), "Vite bundler configuration"),
    **dict.fromkeys(("rollup.config.js", "rollup.config.ts"), "Rollup bundler configuration"),
    **dict.fromkeys(("babel.config.js", ".babelrc"), "Babel transpiler configuration"),
    **dict.fromkeys(("tailwind.config.js", "tailwind.config.ts"), "Tailwind CSS configuration"),
    "postcss.config.js": "PostCSS configuration",
    ".env.example": "Environment variable template",
    **dict.fromkeys(("LICENSE", "LICENSE.md"), "License"),
    **dict.fromkeys(("CHANGELOG.md", "CHANGELOG"), "Changelog"),
    **dict.fromkeys(("README.md", "README"), "Project documentation"),
    "go.mod": "Go module definition",
    "go.sum": "Go dependency checksums",
    "requirements.txt": "Python dependency list",
    "pyproject.toml": "Python project configuration",
    **dict.fromkeys(("setup.py", "setup.cfg"), "Python package setup"),
    "Gemfile": "Ruby gem dependencies",
    "Brewfile": "Homebrew bundle dependencies",
}
# Words that a call pattern of C also fits.
C_KEYWORDS = ("if", "for", "while", "switch", "return")


def captures(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _listed(found: Column, n: int, fallback: str, label: str = "") -> Column:
    """The first n found, comma-joined after the label; the fallback if there are none."""
    return F.when(F.size(found) == 0, fallback).otherwise(F.concat(F.lit(label), F.array_join(F.slice(found, 1, n), ", ")))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _one(text: Column, pattern: str, label: str, fallback: str) -> Column:
    return F.when(text.rlike(pattern), F.concat(F.lit(label), _trimmed(F.regexp_extract(text, pattern, 1)))).otherwise(fallback)


def html_title(text: Column) -> Column:
    return _one(text, "<title>([^<]+)</title>", "", "HTML document")


def shell(text: Column) -> Column:
    pattern = r"(?mdU)^(?:function\s+(\w+)|(\w+)\s*\(\))"
    return _listed(F.zip_with(captures(text, pattern, 1), captures(text, pattern, 2), lambda a, b: F.concat(a, b)), 5, "shell script", "shell: ")


def terraform(text: Column) -> Column:
    pattern = r'(?mdU)^resource\s+"(\w+)"\s+"(\w+)"'
    pairs = F.zip_with(captures(text, pattern, 1), captures(text, pattern, 2), lambda kind, name: F.concat(kind, F.lit("."), name))
    return _listed(pairs, 5, "Terraform configuration", "resources: ")


def yaml(name: Column, text: Column) -> Column:
    services = captures(text, r"(?mdU)^\s{2}(\w[\w-]+):$")
    workflow = F.contains(text, F.lit("on:")) & (F.contains(text, F.lit("jobs:")) | F.contains(text, F.lit("workflow")))
    composed = F.contains(F.lower(name), F.lit("compose")) & (F.size(services) > 0)
    return (
        F.when(composed, _listed(services, 5, "", "compose services: "))
        .when(workflow, _one(text, r"(?mdU)^name:\s*([^\n]+)", "GHA: ", "GitHub Actions workflow"))
        .otherwise("YAML configuration")
    )


def c_functions(text: Column) -> Column:
    return _listed(F.filter(captures(text, r"(?mdU)^\w[\w\s*]+\s+(\w+)\s*\("), lambda n: ~n.isin(*C_KEYWORDS)), 5, "C/C++ source")


def proto(text: Column) -> Column:
    part = lambda word, n: F.nullif(_listed(captures(text, rf"(?mdU)^{word}\s+(\w+)"), n, "", f"{word}s: "), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws("; ", part("service", 2), part("message", 3)), F.lit("")), F.lit("Protocol Buffers"))


def xml(text: Column) -> Column:
    tag = F.regexp_extract(text, r"(?U)<(\w+)[\s>]", 1)
    return F.when(tag.isin("", "xml"), "XML document").otherwise(F.concat(F.lit("XML: <"), tag, F.lit(">")))


def by_extension(name: Column, ext: Column, text: Column) -> Column:
    some = lambda pattern, n, fallback, label="": _listed(captures(text, pattern), n, fallback, label)
    return (
        F.when(ext.isin("sh", "bash", "zsh", "fish"), shell(text))
        .when(ext.isin("md", "mdx"), _one(text, r"(?md)^# ([^\n]*)", "", "markdown document"))
        .when(ext.isin("html", "htm"), html_title(text))
        .when(ext.isin("css", "scss", "sass", "less"), some(r"(?mdU)^([.#]?[\w-]+)\s*\{", 5, "stylesheet", "styles: "))
        .when(ext == "sql", some(r"(?mdiU)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?(\w+)", 5, "SQL script", "tables: "))
        .when(ext.isin("yaml", "yml"), yaml(name, text))
        .when(ext == "json", F.when(F.endswith(name, F.lit(".schema.json")), "JSON schema").otherwise("JSON data"))
        .when(ext.isin("graphql", "gql"), some(r"(?mdU)^type\s+(\w+)", 5, "GraphQL schema", "types: "))
        .when(ext.isin("tf", "tfvars", "hcl"), terraform(text))
        .when(ext == "xml", xml(text))
        .when(ext == "vue", _one(text, r"(?mdU)name:\s*['\"](\w+)['\"]", "Vue: ", "Vue component"))
        .when(ext == "svelte", F.when(F.contains(text, F.lit("<script")), "Svelte component").otherwise("Svelte template"))
        .when(ext == "rb", some(r"(?mdU)^(?:class|module)\s+(\w+)", 3, "Ruby source"))
        .when(ext.isin("java", "kt"), some(r"(?mdU)^(?:public\s+)?(?:class|interface|enum)\s+(\w+)", 3, "JVM source"))
        .when(ext.isin("c", "cpp", "h", "hpp"), c_functions(text))
        .when(ext == "swift", some(r"(?mdU)^(?:class|struct|enum|protocol)\s+(\w+)", 3, "Swift source"))
        .when(ext == "proto", proto(text))
        .otherwise(F.concat(ext, F.lit(" source file")))
    )


def known_label(name: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in KNOWN_FILES.items() for x in pair)), name)


def describe(name: Column, ext: Column, text: Column, declared: Column | None = None) -> Column:
    """By known file name, then by what a code file declares (if given and not empty), then by extension."""
    code = F.lit(None).cast("string") if declared is None else F.nullif(declared, F.lit(""))
    return F.coalesce(known_label(name), code, by_extension(name, ext, text))

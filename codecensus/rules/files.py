"""Names, extensions and path patterns that classify a file."""

# They decide language, kind and what is ignored.

# extension -> (language, comment prefixes)
EXTENSIONS = {
    ".py": ("Python", ("#",)),
    ".pyi": ("Python", ("#",)),
    ".ipynb": ("Jupyter", ("#",)),
    ".js": ("JavaScript", ("//", "*", "/*")),
    ".jsx": ("JavaScript", ("//", "*", "/*")),
    ".mjs": ("JavaScript", ("//", "*", "/*")),
    ".cjs": ("JavaScript", ("//", "*", "/*")),
    ".ts": ("TypeScript", ("//", "*", "/*")),
    ".tsx": ("TypeScript", ("//", "*", "/*")),
    ".mts": ("TypeScript", ("//", "*", "/*")),
    ".vue": ("Vue", ("//", "<!--")),
    ".svelte": ("Svelte", ("//", "<!--")),
    ".go": ("Go", ("//",)),
    ".rs": ("Rust", ("//",)),
    ".java": ("Java", ("//", "*", "/*")),
    ".kt": ("Kotlin", ("//", "*", "/*")),
    ".kts": ("Kotlin", ("//", "*", "/*")),
    ".scala": ("Scala", ("//", "*")),
    ".groovy": ("Groovy", ("//", "*")),
    ".cs": ("C#", ("//", "*")),
    ".fs": ("F#", ("//",)),
    ".vb": ("VB.NET", ("'",)),
    ".rb": ("Ruby", ("#",)),
    ".erb": ("Ruby", ("#", "<%#")),
    ".php": ("PHP", ("//", "#", "*")),
    ".c": ("C", ("//", "*")),
    ".h": ("C", ("//", "*")),
    ".cc": ("C++", ("//", "*")),
    ".cpp": ("C++", ("//", "*")),
    ".cxx": ("C++", ("//", "*")),
    ".hpp": ("C++", ("//", "*")),
    ".m": ("Objective-C", ("//", "*")),
    ".mm": ("Objective-C++", ("//", "*")),
    ".swift": ("Swift", ("//", "*")),
    ".dart": ("Dart", ("//", "*")),
    ".ex": ("Elixir", ("#",)),
    ".exs": ("Elixir", ("#",)),
    ".erl": ("Erlang", ("%",)),
    ".hs": ("Haskell", ("--",)),
    ".clj": ("Clojure", (";",)),
    ".lua": ("Lua", ("--",)),
    ".pl": ("Perl", ("#",)),
    ".r": ("R", ("#",)),
    ".jl": ("Julia", ("#",)),
    ".sh": ("Shell", ("#",)),
    ".bash": ("Shell", ("#",)),
    ".zsh": ("Shell", ("#",)),
    ".fish": ("Shell", ("#",)),
    ".ps1": ("PowerShell", ("#",)),
    ".sql": ("SQL", ("--",)),
    ".proto": ("Protobuf", ("//",)),
    ".graphql": ("GraphQL", ("#",)),
    ".gql": ("GraphQL", ("#",)),
    ".tf": ("Terraform", ("#",)),
    ".tfvars": ("Terraform", ("#",)),
    ".hcl": ("HCL", ("#",)),
    ".bicep": ("Bicep", ("//",)),
    ".yaml": ("YAML", ("#",)),
    ".yml": ("YAML", ("#",)),
    ".json": ("JSON", ()),
    ".jsonc": ("JSON", ("//",)),
    ".toml": ("TOML", ("#",)),
    ".ini": ("INI", ("#", ";")),
    ".cfg": ("INI", ("#", ";")),
    ".env": ("Dotenv", ("#",)),
    ".xml": ("XML", ("<!--",)),
    ".html": ("HTML", ("<!--",)),
    ".htm": ("HTML", ("<!--",)),
    ".css": ("CSS", ("/*", "*")),
    ".scss": ("SCSS", ("//", "/*")),
    ".sass": ("SCSS", ("//",)),
    ".less": ("Less", ("//", "/*")),
    ".md": ("Markdown", ()),
    ".mdx": ("Markdown", ()),
    ".rst": ("reStructuredText", ()),
    ".adoc": ("AsciiDoc", ()),
    ".txt": ("Text", ()),
    ".csv": ("CSV", ()),
    ".gradle": ("Gradle", ("//",)),
    ".cmake": ("CMake", ("#",)),
    ".mk": ("Make", ("#",)),
    ".dockerfile": ("Dockerfile", ("#",)),
}

FILENAMES = {
    "dockerfile": ("Dockerfile", ("#",)),
    "containerfile": ("Dockerfile", ("#",)),
    "makefile": ("Make", ("#",)),
    "justfile": ("Make", ("#",)),
    "rakefile": ("Ruby", ("#",)),
    "gemfile": ("Ruby", ("#",)),
    "brewfile": ("Ruby", ("#",)),
    "procfile": ("Config", ("#",)),
    "vagrantfile": ("Ruby", ("#",)),
    "jenkinsfile": ("Groovy", ("//",)),
    "cmakelists.txt": ("CMake", ("#",)),
    "go.mod": ("Go", ("//",)),
    "go.sum": ("Go", ()),
}

CODE_LANGUAGES = (
    "Python", "JavaScript", "TypeScript", "Vue", "Svelte", "Go", "Rust", "Java", "Kotlin", "Scala",
    "Groovy", "C#", "F#", "VB.NET", "Ruby", "PHP", "C", "C++", "Objective-C", "Objective-C++", "Swift",
    "Dart", "Elixir", "Erlang", "Haskell", "Clojure", "Lua", "Perl", "R", "Julia", "Shell", "PowerShell",
)

IGNORED_DIRS = (
    ".git", ".hg", ".svn", ".idea", ".vscode-test", "node_modules", "bower_components", "vendor",
    "venv", ".venv", "env310", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox",
    ".nox", "dist", "build", "out", "target", ".next", ".nuxt", ".svelte-kit", ".output",
    ".parcel-cache", ".turbo", ".cache", "coverage", "htmlcov", ".terraform", ".serverless", "Pods",
    "DerivedData", "obj", ".gradle", ".m2", ".dart_tool", "site-packages", ".yarn", ".pnpm-store",
)

VENDOR_DIRS = (
    "node_modules", "vendor", "third_party", "Pods", "site-packages",
)

KEPT_DOT_DIRS = (".github", ".gitlab", ".circleci")

IGNORED_GLOBS = (
    "*.min.js", "*.min.css", "*.map", "*.log", "*.pyc", "*.pyo", "*.class", "*.o", "*.so", "*.dylib",
    "*.dll", "*.exe", "*.jar", "*.war", "*.zip", "*.tar", "*.tar.gz", "*.tgz", "*.rar", "*.7z", "*.png",
    "*.jpg", "*.jpeg", "*.gif", "*.bmp", "*.ico", "*.svg", "*.webp", "*.mp4", "*.mp3", "*.wav", "*.avi",
    "*.mov", "*.pdf", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.otf", "*.db", "*.sqlite", "*.sqlite3",
    "*.bin", "*.dat", "*.pkl", "*.h5", "*.parquet", "*.avro", "*.wasm", "*.node", "*.snap", "*.pb.go",
    "*_pb2.py", "*.generated.*", "*.designer.cs",
)

TEST_PATHS = (
    "(^|/)tests?/",
    "(^|/)__tests__/",
    "(^|/)spec/",
    "(^|/)e2e/",
    r"_test\.[a-z]+$",
    r"^test_[^/]*\.py$",
    r"[./]test_[^/]*\.py$",
    r"\.(test|spec)\.[jt]sx?$",
    r"Test[s]?\.(java|kt|cs|scala)$",
    r"_spec\.rb$",
)

INFRA_PATHS = (
    "(^|/)(deploy|deployment|k8s|kubernetes|helm|charts|manifests|infra|infrastructure|terraform|ansible|pulumi|cloudformation)/",
    r"docker-compose[.\w-]*\.ya?ml$",
    r"(^|/)Dockerfile[.\w-]*$",
    r"\.tf$",
    r"\.bicep$",
    r"(^|/)\.github/workflows/",
    r"(^|/)\.gitlab-ci\.ya?ml$",
    r"(^|/)serverless\.ya?ml$",
    r"(^|/)skaffold\.ya?ml$",
)

BUILD_FILES = (
    "package.json", "pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json", "pyproject.toml",
    "setup.py", "setup.cfg", "requirements.txt", "pipfile", "go.mod", "cargo.toml", "pom.xml",
    "build.gradle", "build.gradle.kts", "gemfile", "composer.json", "makefile", "cmakelists.txt",
    "build.sbt", "mix.exs", "pubspec.yaml", "deno.json", "bun.lockb", "rush.json",
)

DOC_LANGUAGES = (
    "Markdown", "reStructuredText", "AsciiDoc", "Text",
)

CONFIG_LANGUAGES = (
    "YAML", "JSON", "TOML", "INI", "XML", "Dotenv", "Config",
)

SCHEMA_LANGUAGES = ("SQL", "Protobuf", "GraphQL")
INFRA_LANGUAGES = ("Terraform", "HCL", "Bicep", "Dockerfile")

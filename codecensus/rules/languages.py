"""Import, symbol, endpoint and framework rules per language.

A rule gives the languages, a pattern, the number of groups and SQL over the match:
``g`` (groups from g[0]), ``m`` (matched line, stripped), ``path`` and ``frameworks``.
A negative number of groups means: group 1 only leads up to the match, g starts at group 2.
"""

PYTHON = ("Python",)
JS = ("JavaScript", "TypeScript", "Vue", "Svelte")
JVM = ("Java", "Kotlin", "Scala", "Groovy")
C_LIKE = ("C", "C++", "Objective-C", "Objective-C++")
# Languages whose block comments are removed before matching.
BLOCK_COMMENTS = JS + ("Go",) + JVM + ("C#", "PHP", "Rust") + C_LIKE + ("Swift", "Dart")

# Patterns. (languages, pattern, groups, module SQL, relative SQL)
IMPORTS = (
    (PYTHON, r"^[^\S\n]*(?:from\s+([.\w]+)\s+import\b|import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*))",
     2, "concat(g[0], g[1])", "startswith(g[0], '.')"),
    (JS, r"""^\s*(?:import|export)\s+(?:type\s+)?(?:[\w*{},\s\n]+?\s+from\s+)?['"]([^'"]+)['"]""", 1, "g[0]", "startswith(g[0], '.')"),
    (JS, r"""^\s*import\s+['"]([^'"]+)['"]""", 1, "g[0]", "startswith(g[0], '.')"),
    (JS, r"""require\(\s*['"]([^'"]+)['"]\s*\)""", 1, "g[0]", "startswith(g[0], '.')"),
    (JS, r"""import\(\s*['"]([^'"]+)['"]\s*\)""", 1, "g[0]", "startswith(g[0], '.')"),
    (("Go",), r'''^\s*import\s+(?:\w+\s+)?"([^"]+)"''', 1, "g[0]", "false"),
    # Every quoted path of an import block; the chain of matches starts at "import (".
    (("Go",), r'''((?:\bimport\s*\(|\G(?!\A))[^()"]*)"([^"\n]+)"''', -2, "g[0]", "false"),
    (JVM, r"^\s*import\s+(?:static\s+)?([\w.*]+)", 1, "g[0]", "false"),
    (("C#",), r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", 1, "g[0]", "false"),
    (("Ruby",), r"""^\s*(require(?:_relative)?)\s+['"]([^'"]+)['"]""", 2, "g[1]", "g[0] = 'require_relative'"),
    (("PHP",), r"^\s*use\s+([\w\\]+)", 1, r"replace(g[0], '\\', '/')", "false"),
    (("PHP",), r"""(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]""", 1, "g[0]", "true"),
    (("Rust",), r"^\s*(?:pub\s+)?use\s+([\w:{}, *]+)\s*;", 1, "trim(substring_index(g[0], '::', 1))", "g[0] RLIKE '^(crate|self|super)'"),
    (("Rust",), r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;", 1, "g[0]", "true"),
    (("Elixir",), r"^\s*(?:import|alias|use|require)\s+([\w.]+)", 1, "g[0]", "false"),
    (C_LIKE, r"""^\s*#\s*include\s*[<"]([^>"]+)([>"])""", 2, "g[0]", """g[1] = '"'"""),
    (("Swift",), r"^\s*import\s+(\w+)", 1, "g[0]", "false"),
    (("Dart",), r"""^\s*import\s+['"]([^'"]+)['"]""", 1, "g[0]", "NOT startswith(g[0], 'package:')"),
    (("Shell",), r"^\s*(?:source|\.)\s+([\w./$-]+)", 1, "g[0]", "true"),
    (("Protobuf",), r"""^\s*import\s+["']([^"']+)["']""", 1, "g[0]", "true"),
)

# Patterns. (languages, pattern, groups, name SQL, kind SQL, exported SQL)
SYMBOLS = (
    (JS, r"^\s*export\s+(?:default\s+)?(?:async\s+)?function\s+(\w+)", 1, "g[0]", "'function'", "true"),
    (JS, r"^\s*export\s+(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", 1, "g[0]", "'class'", "true"),
    (JS, r"^\s*export\s+(?:const|let|var)\s+(\w+)", 1, "g[0]", "'const'", "true"),
    (JS, r"^\s*export\s+(?:interface|type|enum)\s+(\w+)", 1, "g[0]", "'interface'", "true"),
    (JS, r"^\s*(?:abstract\s+)?class\s+(\w+)", 1, "g[0]", "'class'", "false"),
    (JS, r"^\s*(?:async\s+)?function\s+(\w+)", 1, "g[0]", "'function'", "false"),
    (("Go",), r"^func\s+(?:\(\s*\w+\s+\*?(\w+)\s*\)\s*)?(\w+)\s*\(", 2,
     "concat_ws('.', nullif(g[0], ''), g[1])", "CASE WHEN g[0] <> '' THEN 'method' ELSE 'function' END", "g[1] RLIKE '^[A-Z]'"),
    (("Go",), r"^type\s+(\w+)\s+(struct|interface)\b", 2, "g[0]", "g[1]", "g[0] RLIKE '^[A-Z]'"),
    (JVM, r"^\s*(?:public\s+|private\s+|internal\s+|open\s+|final\s+|abstract\s+|sealed\s+|data\s+)*"
          r"(class|interface|enum|record|object|trait)\s+(\w+)", 2, "concat_ws('.', nullif(package, ''), g[1])", "g[0]", "true"),
    (("C#",), r"^\s*(?:public|internal|private|protected|sealed|abstract|static|partial|\s)*"
              r"(class|interface|record|struct|enum)\s+(\w+)", 2, "g[1]", "g[0]", "true"),
    (("Ruby",), r"^\s*(class|module)\s+([\w:]+)", 2, "g[1]", "g[0]", "true"),
    (("Ruby",), r"^\s*def\s+([\w.?!]+)", 1, "g[0]", "'method'", "true"),
    (("PHP",), r"^\s*(?:final\s+|abstract\s+)?(class|interface|trait|enum)\s+(\w+)", 2, "g[1]", "g[0]", "true"),
    (("PHP",), r"^\s*(?:public|private|protected|static|\s)*function\s+(\w+)", 1, "g[0]", "'function'", "true"),
    (("Rust",), r"^\s*(?:pub(?:\([\w:]+\))?\s+)?(fn|struct|enum|trait|impl)\s+(\w+)", 2, "g[1]", "g[0]", "true"),
    (("Elixir",), r"^\s*(defmodule|def|defp)\s+([\w.?!]+)", 2, "g[1]",
     "CASE WHEN g[0] = 'defmodule' THEN 'module' ELSE 'function' END", "g[0] <> 'defp'"),
    (C_LIKE, r"^\s*(?:typedef\s+)?(struct|class|enum|union)\s+(\w+)", 2, "g[1]", "g[0]", "true"),
    (C_LIKE, r"^[\w:*&<>\s]+?\b(?!(?:if|for|while|switch|catch|return)\b)(\w+)\s*\([^;{]*\)\s*\{", 1, "g[0]", "'function'", "true"),
    (("Swift",), r"^\s*(?:public\s+|open\s+|internal\s+|final\s+)*(class|struct|enum|protocol|extension)\s+(\w+)", 2, "g[1]", "g[0]", "true"),
    (("Swift",), r"^\s*(?:public\s+|private\s+|static\s+|override\s+)*func\s+(\w+)", 1, "g[0]", "'function'", "true"),
    (("Dart",), r"^\s*(?:abstract\s+)?(class|mixin|enum)\s+(\w+)", 2, "g[1]", "g[0]", "true"),
    (("Shell",), r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{", 1, "g[0]", "'function'", "true"),
    (("SQL",), r'''(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(TABLE|VIEW|MATERIALIZED\s+VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?["`\[]?([\w.]+)''', 2,
     "g[1]", "'table'", "true"),
    (("SQL",), r'''(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(FUNCTION|PROCEDURE)\s+["`\[]?([\w.]+)''', 2, "g[1]", "'procedure'", "true"),
    (("Protobuf",), r"^\s*service\s+(\w+)", 1, "g[0]", "'service'", "true"),
    (("Protobuf",), r"^\s*message\s+(\w+)", 1, "g[0]", "'message'", "true"),
    (("GraphQL",), r"^\s*(type|input|enum|interface|union)\s+(\w+)", 2, "g[1]", "g[0]", "true"),
)

_NODE = "coalesce(try_element_at(filter(array('Express', 'Fastify', 'Koa', 'Hapi'), f -> array_contains(frameworks, f)), 1), 'Node HTTP')"
_GO = "coalesce(try_element_at(frameworks, 1), 'net/http')"

# Patterns. (languages, pattern, groups, condition SQL, kind, method SQL, path SQL, handler SQL, framework SQL)
ENDPOINTS = (
    (PYTHON, r"""(?:add_url_rule|add_route|router\.add_api_route|app\.add_api_route)\s*\(\s*["']([^"']+)["']""", 1,
     "true", "http", "'ANY'", "g[0]", "''", "'Python'"),
    (PYTHON, r"""(?:router|app)\.add_(get|post|put|patch|delete|route)\s*\(\s*["']([^"']+)["']""", 2,
     "true", "http", "upper(g[0])", "g[1]", "''", "'aiohttp'"),
    (PYTHON, r"""\b(?:path|re_path|url)\s*\(\s*r?["']([^"'\n]*)["'](?:\s*,\s*([\w.]+))?""", 2,
     "endswith(path, 'urls.py')", "http", "'ANY'", "g[0]", "g[1]", "'Django'"),
    (JS, r"""\b(?:app|router|server|api|fastify|route[rs]?)\w*\.(get|post|put|patch|delete|head|options|all|use)\s*\(\s*[`'"]([^`'"]+)[`'"]""", 2,
     "startswith(g[1], '/') OR (contains(g[1], '*') AND g[0] <> 'use')", "http",
     "CASE WHEN g[0] IN ('use', 'all') THEN 'ANY' ELSE upper(g[0]) END", "g[1]", "''", _NODE),
    (JS, r"""@(Get|Post|Put|Patch|Delete|Options|Head|All|Sse)\(\s*[`'"]?([^`'")]*)[`'"]?\s*\)\s*(?:async\s+)?(\w+)?""", 3,
     "nest", "http", "upper(g[0])", "concat(base, '|', g[1])", "g[2]", "'NestJS'"),
    (JS, r"""@(EventPattern|MessagePattern|SubscribeMessage|Cron|Interval)\(\s*[`'"]?([^`'")]*)""", 2,
     "nest", "event", "upper(g[0])", "CASE WHEN g[1] = '' THEN path ELSE g[1] END", "''", "'NestJS'"),
    (JS, r"^\s*(\w+)\s*:\s*(?:publicProcedure|protectedProcedure|t\.procedure)", 1, "true", "http", "'RPC'", "g[0]", "g[0]", "'tRPC'"),
    (JS, r"^\s*(?:export\s+const|exports?\.)\s*(handler|main)\b", 1, "true", "function", "'INVOKE'", "path", "g[0]", "'Serverless'"),
    (("Go",), r'''\b(?:\w+)\.(HandleFunc|Handle|GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete|Any)\s*\(\s*"([^"]+)"(?:\s*,\s*"([^"]+)")?''', 3,
     "startswith(CASE WHEN g[0] LIKE 'Handle%' AND g[2] <> '' THEN g[2] ELSE g[1] END, '/')", "http",
     "CASE WHEN g[0] NOT LIKE 'Handle%' THEN upper(g[0]) WHEN g[2] <> '' THEN upper(g[1]) ELSE 'ANY' END",
     "CASE WHEN g[0] LIKE 'Handle%' AND g[2] <> '' THEN g[2] ELSE g[1] END", "''", _GO),
    (JVM, r"""@(Get|Post|Put|Patch|Delete|Request)Mapping\s*\(\s*(?:value\s*=\s*)?[{\s]*["']([^"']*)["']?""", 2,
     "NOT (g[0] = 'Request' AND line = class_line)", "http", "CASE WHEN g[0] = 'Request' THEN 'ANY' ELSE upper(g[0]) END",
     "concat(base, '|', g[1])", "''", "'Spring'"),
    (JVM, r"@(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b", 1, "true", "http", "g[0]", "concat(jax_root, '|')", "''", "'JAX-RS'"),
    (("C#",), r"""\[Http(Get|Post|Put|Patch|Delete|Head|Options)(?:\(\s*["']([^"']*)["'])?""", 2,
     "true", "http", "upper(g[0])", "concat(base, '|', g[1])", "''", "'ASP.NET Core'"),
    (("C#",), r"""\bapp\.Map(Get|Post|Put|Patch|Delete|Group)\s*\(\s*["']([^"']+)["']""", 2,
     "true", "http", "upper(g[0])", "g[1]", "''", "'ASP.NET Minimal API'"),
    (("Ruby",), r"""^\s*(get|post|put|patch|delete|resources?|namespace|root)\s+['":]([^'",\s]+)""", 2,
     "endswith(path, 'routes.rb') OR sinatra", "http",
     "CASE WHEN g[0] IN ('resources', 'resource', 'namespace', 'root') THEN 'ANY' ELSE upper(g[0]) END", "g[1]", "''",
     "CASE WHEN endswith(path, 'routes.rb') THEN 'Rails' ELSE 'Sinatra' END"),
    (("PHP",), r"""Route::(get|post|put|patch|delete|any|match)\s*\(\s*['"]([^'"]+)['"]""", 2, "true", "http", "upper(g[0])", "g[1]", "''", "'Laravel'"),
    (("PHP",), r"""(?s)#\[Route\(\s*['"]([^'"]+)['"](?:.*?methods\s*:\s*\[['"](\w+)['"])?""", 2, "true", "http",
     "CASE WHEN g[1] = '' THEN 'ANY' ELSE upper(g[1]) END", "g[0]", "''", "'Symfony'"),
    (("Rust",), r"""#\[(get|post|put|patch|delete|head)\(\s*["']([^"']+)["']""", 2, "true", "http", "upper(g[0])", "g[1]", "''", "'Actix'"),
    (("Rust",), r"""\.route\(\s*["']([^"']+)["']\s*,\s*(\w+)\(""", 2, "true", "http", "upper(g[1])", "g[0]", "''", "'Axum'"),
    (("Elixir",), r'''^\s*(get|post|put|patch|delete|live)\s+"([^"]+)"''', 2,
     "array_contains(frameworks, 'Phoenix')", "http", "upper(g[0])", "g[1]", "''", "'Phoenix'"),
    (("Protobuf",), r"^\s*rpc\s+(\w+)\s*\(([^)]*)\)\s*returns\s*\(([^)]*)\)", 3, "true", "grpc", "'RPC'",
     "CASE WHEN base = '' THEN g[0] ELSE concat(base, '/', g[0]) END", "g[0]", "'gRPC'"),
)
# Endpoint rules whose path is taken as it stands, without a leading slash being added.
RAW_PATHS = ("event", "function", "grpc")
RAW_FRAMEWORKS = ("Axum", "Actix", "Phoenix", "ASP.NET Minimal API")

# Route decorators and task decorators of Python.
ROUTE_DECORATORS = ("route", "get", "post", "put", "patch", "delete", "head", "options", "websocket")
TASK_DECORATORS = ("task", "shared_task", "celery_task", "periodic_task")
PYTHON_WEB = ("FastAPI", "Flask", "Sanic", "Starlette", "aiohttp")

# Framework markers. (languages, framework, pattern)
FRAMEWORKS = (
    (PYTHON, "FastAPI", r"(?i)\bfastapi\b"),
    (PYTHON, "Flask", r"(?i)\bflask\b"),
    (PYTHON, "Django", r"(?i)\bdjango\b"),
    (PYTHON, "Starlette", r"(?i)\bstarlette\b"),
    (PYTHON, "aiohttp", r"(?i)\baiohttp\b"),
    (PYTHON, "Sanic", r"(?i)\bsanic\b"),
    (PYTHON, "Tornado", r"(?i)\btornado\b"),
    (PYTHON, "Celery", r"(?i)\bcelery\b"),
    (PYTHON, "SQLAlchemy", r"(?i)\bsqlalchemy\b"),
    (PYTHON, "Pydantic", r"(?i)\bpydantic\b"),
    (PYTHON, "Click", r"(?i)\bclick\b"),
    (PYTHON, "Typer", r"(?i)\btyper\b"),
    (PYTHON, "pytest", r"(?i)\bpytest\b"),
    (PYTHON, "Pandas", r"(?i)\bpandas\b"),
    (PYTHON, "Airflow", r"(?i)\bairflow\b"),
    (PYTHON, "Boto3", r"(?i)\b(?:boto3|botocore)\b"),
    (PYTHON, "gRPC", r"(?i)\bgrpc\b"),
    (PYTHON, "Strawberry GraphQL", r"(?i)\bstrawberry\b"),
    (PYTHON, "Graphene", r"(?i)\bgraphene\b"),
    (JS, "React", r"from\s+['\"]react['\"]|React\."),
    (JS, "Next.js", r"from\s+['\"]next[/'\"]|next/server"),
    (JS, "Vue", r"from\s+['\"]vue['\"]"),
    (JS, "Angular", r"@angular/"),
    (JS, "Svelte", r"from\s+['\"]svelte"),
    (JS, "Express", r"from\s+['\"]express['\"]|require\(['\"]express['\"]\)"),
    (JS, "NestJS", r"@nestjs/"),
    (JS, "Fastify", r"['\"]fastify['\"]"),
    (JS, "Koa", r"['\"]koa['\"]"),
    (JS, "Hapi", r"@hapi/"),
    (JS, "tRPC", r"@trpc/"),
    (JS, "GraphQL", r"graphql|apollo"),
    (JS, "Prisma", r"@prisma/|PrismaClient"),
    (JS, "TypeORM", r"typeorm"),
    (JS, "Sequelize", r"sequelize"),
    (JS, "Mongoose", r"mongoose"),
    (JS, "Socket.IO", r"socket\.io"),
    (JS, "Jest", r"['\"]jest['\"]|\bdescribe\("),
    (JS, "Vitest", r"['\"]vitest['\"]"),
    (JS, "Playwright", r"@playwright/"),
    (JS, "AWS SDK", r"aws-sdk|@aws-sdk/"),
    (JS, "Electron", r"['\"]electron['\"]"),
    (JS, "Redux", r"['\"]redux['\"]|@reduxjs/"),
    (JS, "Tailwind", r"tailwind"),
    (("Go",), "Gin", r"gin-gonic"),
    (("Go",), "Echo", r"labstack/echo"),
    (("Go",), "Chi", r"go-chi/chi"),
    (("Go",), "Fiber", r"gofiber"),
    (("Go",), "gorilla/mux", r"gorilla/mux"),
    (("Go",), "gRPC", r"google\.golang\.org/grpc"),
    (("Go",), "GORM", r"gorm\.io"),
    (("Go",), "sqlx", r"jmoiron/sqlx"),
    (("Go",), "Cobra", r"spf13/cobra"),
    (("Go",), "Kafka", r"segmentio/kafka-go"),
    (JVM, "Spring Boot", r"org\.springframework\.boot"),
    (JVM, "Spring", r"org\.springframework"),
    (JVM, "Jakarta EE", r"jakarta\."),
    (JVM, "JAX-RS", r"javax\.ws\.rs"),
    (JVM, "Hibernate", r"org\.hibernate"),
    (JVM, "JPA", r"javax\.persistence"),
    (JVM, "Kafka", r"org\.apache\.kafka"),
    (JVM, "Micronaut", r"io\.micronaut"),
    (JVM, "Quarkus", r"io\.quarkus"),
    (JVM, "Ktor", r"io\.ktor"),
    (JVM, "JUnit", r"org\.junit"),
    (JVM, "Lombok", r"lombok"),
    (JVM, "Reactor", r"reactor\.core"),
    (JVM, "Android", r"android\."),
    (("C#",), "ASP.NET Core", r"Microsoft\.AspNetCore"),
    (("C#",), "Entity Framework", r"Microsoft\.EntityFrameworkCore"),
    (("C#",), "Dapper", r"Dapper"),
    (("C#",), "MediatR", r"MediatR"),
    (("C#",), "Serilog", r"Serilog"),
    (("C#",), "xUnit", r"Xunit"),
    (("C#",), "Azure SDK", r"Azure\."),
    (("C#",), "MassTransit", r"MassTransit"),
    (("C#",), "Blazor", r"Microsoft\.AspNetCore\.Components"),
    (("Ruby",), "Ruby on Rails", r"Rails|rails"),
    (("Ruby",), "Sinatra", r"sinatra"),
    (("PHP",), "Laravel", r"Illuminate\\|Laravel"),
    (("PHP",), "Symfony", r"Symfony\\"),
    (("Rust",), "Actix", r"actix_web"),
    (("Rust",), "Axum", r"axum"),
    (("Rust",), "Rocket", r"rocket"),
    (("Rust",), "Tokio", r"tokio"),
    (("Rust",), "Serde", r"serde"),
    (("Rust",), "SQLx", r"sqlx"),
    (("Rust",), "Diesel", r"diesel"),
    (("Elixir",), "Phoenix", r"Phoenix"),
    (("Swift",), "SwiftUI", r"SwiftUI"),
    (("Swift",), "Vapor", r"Vapor"),
    (("Dart",), "Flutter", r"flutter"),
)

# What marks a file as a program entry. (languages, pattern)
ENTRYPOINTS = (
    (PYTHON, r"(?m)^if\s+__name__\s*==\s*[\"']__main__[\"']"),
    (JS, r"(?m)^\s*(?:export\s+const|exports?\.)\s*(?:handler|main)\b|^\s*(?:#!.*node|require\(['\"]yargs|commander)"),
    (("Go",), r"(?m)^func\s+main\s*\("),
    (JVM, r"(fun|void|static\s+void)\s+main\s*\("),
    (("Rust",), r"(?m)^\s*(?:pub(?:\([\w:]+\))?\s+)?fn\s+main\b"),
    (C_LIKE, r"(?m)^[\w:*&<>\s]+?\bmain\s*\([^;{]*\)\s*\{"),
    (("Shell",), r"\A#!"),
)

"""Constant dimensions: which package marks which framework, and how languages are laid out. Fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: framework: language, packages, packages for API descriptions, excluded packages, generation commands by package. Fixed.
FRAMEWORKS = {
    "gin": ("go", ["github.com/gin-gonic/gin"], ["github.com/swaggo/swag", "github.com/go-swagger/go-swagger", "github.com/swaggo/gin-swagger"], [], {"github.com/swaggo/swag": "swag init", "github.com/go-swagger/go-swagger": "swagger generate spec"}),
    "echo": ("go", ["github.com/labstack/echo"], ["github.com/swaggo/echo-swagger", "github.com/swaggo/swag"], [], {"github.com/swaggo/swag": "swag init"}),
    "fastapi": ("python", ["fastapi", "starlette"], ["openapi-spec-validator", "pydantic"], [], {"fastapi": "python -c 'import json; from main import app; print(json.dumps(app.openapi()))'"}),
    "flask": ("python", ["flask"], ["flask-smorest", "flasgger", "flask-restx", "apispec"], ["fastapi"], {"flasgger": "flask spec", "flask-restx": "flask openapi.json"}),
    "django": ("python", ["django"], ["drf-spectacular", "drf-yasg", "django-rest-swagger"], [], {"drf-spectacular": "python manage.py spectacular --file schema.yml", "drf-yasg": "python manage.py generate_swagger schema.json"}),
    "springboot": ("java", ["spring-boot-starter-web"], ["springdoc-openapi-ui", "springfox-swagger2", "springfox-boot-starter"], [], {"springdoc-openapi-ui": "./mvnw spring-boot:run & curl localhost:8080/v3/api-docs"}),
    "rails": ("ruby", ["rails"], ["rswag", "rswag-ui", "rswag-api", "grape-swagger"], [], {"rswag": "rake rswag:specs:swaggerize"}),
    "laravel": ("php", ["laravel/framework"], ["darkaonline/l5-swagger", "zircote/swagger-php"], [], {"darkaonline/l5-swagger": "php artisan l5-swagger:generate"}),
    "symfony": ("php", ["symfony/routing", "symfony/framework-bundle", "symfony/http-kernel"], ["nelmio/api-doc-bundle"], [], {"nelmio/api-doc-bundle": "php bin/console nelmio:apidoc:dump --format=yaml"}),
    "actix": ("rust", ["actix-web"], ["utoipa", "paperclip"], [], {"utoipa": "cargo run --example generate_spec"}),
    "express": ("typescript", ["express"], ["swagger-ui-express", "swagger-jsdoc", "tsoa", "@nestjs/swagger"], [], {"tsoa": "tsoa spec", "swagger-jsdoc": "swagger-jsdoc -d swaggerDef.js"}),
}

#: language: manifests, frameworks in order of priority, extensions of sources. Fixed.
JS = (["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "package.json", "npm-shrinkwrap.json"], ["express"], [".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs"])
LANGUAGES = {
    "go": (["go.mod", "go.sum", "vendor/modules.txt", "Gopkg.toml", "Gopkg.lock", "glide.yaml", "glide.lock"], ["gin", "echo"], [".go"]),
    "python": (["requirements.txt", "uv.lock", "poetry.lock", "pyproject.toml", "Pipfile.lock", "Pipfile", "environment.yml", "setup.py", "setup.cfg"], ["flask", "django", "fastapi"], [".py"]),
    "java": (["pom.xml", "build.gradle", "build.gradle.kts"], ["springboot"], [".java", ".kt", ".scala"]),
    "rust": (["Cargo.toml", "Cargo.lock"], ["actix"], [".rs"]),
    "ruby": (["Gemfile", "Gemfile.lock"], ["rails"], [".rb"]),
    "node": JS,
    "javascript": JS,
    "typescript": JS,
    "php": (["composer.lock", "composer.json"], ["laravel", "symfony"], [".php"]),
}
#: Extensions where the language is unknown. Fixed.
EXTENSIONS = [".py", ".go", ".java", ".rs", ".rb", ".js", ".ts", ".php"]
#: Names of API descriptions, directories that hide them, parts of directory names that do. Fixed.
OPENAPI_FILES = [
    "openapi.yaml", "openapi.yml", "openapi.json", "swagger.yaml", "swagger.yml", "swagger.json", "api.yaml", "api.yml", "api.json",
    "api-docs.yaml", "api-docs.yml", "api-docs.json", "openapi-spec.yaml", "openapi-spec.yml", "openapi-spec.json",
    "swagger-spec.yaml", "swagger-spec.yml", "swagger-spec.json",
]
IGNORED_DIRECTORIES = [
    "test", "tests", "__tests__", "__test__", "fixture", "fixtures", "example", "examples", "sample", "samples", "seed", "demo", "demos", "testdata",
    "node_modules", "vendor", "bower_components", "dist", "build", "temp", "tmp", ".github", "site-packages", "mock", "mocks", "coverage", "bin", "obj",
]
IGNORED_PARTS = ["-test", "_test", "test-", "test_", "fixture", "example"]
METHODS = ["get", "post", "put", "delete", "patch", "options", "head"]
HEAVY_DIRECTORIES = ["node_modules", "vendor", "dist", "build", "bin", ".github", "tests", "test"]
HEAVY_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".mp4", ".zip", ".tar", ".pdf", ".exe", ".dll", ".so"]
CATEGORIES = ["Web Application", "Web Framework", "General Library", "Dev/Security Tool", "Infrastructure", "Tutorial/Course", "Data/Resource", "Other"]


def framework_packages(spark: SparkSession) -> DataFrame:
    """language, framework, package_name, usage (core, openapi, excluded), priority, position, for every language."""
    rows = []
    for language, (_, frameworks, _) in LANGUAGES.items():
        for priority, framework in enumerate(frameworks):
            _, core, openapi, excluded, _ = FRAMEWORKS[framework]
            for usage, packages in (("core", core), ("openapi", openapi), ("excluded", excluded)):
                rows += [(language, framework, package, usage, priority, position) for position, package in enumerate(packages)]
    return spark.createDataFrame(rows, "language string, framework string, package_name string, usage string, priority int, position int")


def ranked(packages: DataFrame) -> DataFrame:
    """A table (language, framework, package_name, usage) with priority and position, where it has none: the frameworks of
    `LANGUAGES` in their order, then others by name; packages by name."""
    listed = F.create_map(*[F.lit(x) for language, (_, frameworks, _) in LANGUAGES.items() for k, framework in enumerate(frameworks) for x in (f"{language} {framework}", k)])
    known = F.try_element_at(listed, F.concat_ws(" ", F.lower("language"), F.lower("framework")))
    by_language, by_framework = Window.partitionBy("language").orderBy(known.asc_nulls_last(), "framework"), Window.partitionBy("language", "framework", "usage").orderBy("package_name")
    return packages.withColumn("priority", F.dense_rank().over(by_language) - 1).withColumn("position", F.row_number().over(by_framework) - 1)


def commands(spark: SparkSession) -> DataFrame:
    """framework, dependency, command; a dependency named like the framework is the command of last resort."""
    return spark.createDataFrame([(f, d, c) for f, spec in FRAMEWORKS.items() for d, c in spec[4].items()], "framework string, dependency string, command string")


def manifests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(language, name, k) for language, (names, _, _) in LANGUAGES.items() for k, name in enumerate(names)], "language string, manifest string, position int")


def extensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(language, x) for language, (_, _, ends) in LANGUAGES.items() for x in ends], "language string, extension string")


def context_windows(spark: SparkSession, limits: dict[str, int]) -> DataFrame:
    """model, tokens: nine tenths of a model's context, rounded down."""
    rows = spark.createDataFrame(list(limits.items()), "model string, size bigint")
    return rows.select("model", F.floor(F.col("size") * 0.9).alias("tokens"))

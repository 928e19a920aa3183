"""What a project's manifests say it is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import keyword_counts
from ..functions.text import fixed, text_or_empty
from .rule_hits import top

#: Languages by their manifests, in order.
LANGUAGES = {
    "requirements.txt": "Python", "pyproject.toml": "Python", "package.json": "JavaScript/TypeScript", "go.mod": "Go", "pom.xml": "Java", "Gemfile": "Ruby", "composer.json": "PHP", "Cargo.toml": "Rust",
}
#: Category, name and markers of what a language's manifests hold, in order; without a marker, all manifests of the language say so.
PARTS: dict[str, tuple[tuple, ...]] = {
    "Python": (
        ("framework", "Django", "django"), ("framework", "Flask", "flask"), ("framework", "FastAPI", "fastapi"), ("framework", "Tornado", "tornado"), ("orm", "SQLAlchemy", "sqlalchemy"), ("orm", "Django ORM", "django"),
        ("orm", "MongoEngine", "mongoengine"), ("orm", "Peewee", "peewee"), ("database", "PostgreSQL", "psycopg"), ("database", "MySQL", "pymysql", "mysqlclient"), ("database", "SQLite", "sqlite"), ("database", "MongoDB", "pymongo"),
        ("database", "Redis", "redis"), ("message_queue", "Celery", "celery"), ("message_queue", "Redis Queue", "rq"), ("template_engine", "Jinja2", "jinja"), ("auth_library", "JWT", "pyjwt", "jose"),
        ("auth_library", "Flask-Login", "flask-login"), ("auth_library", "Passlib", "passlib", "bcrypt"), ("build_tool", "Setuptools", "setuptools"),
    ),
    "JavaScript/TypeScript": (
        ("framework", "Express", '"express"'), ("framework", "Koa", '"koa"'), ("framework", "NestJS", '"@nestjs/core"'), ("framework", "Fastify", '"fastify"'), ("framework", "Next.js", '"next"'), ("framework", "React", '"react"'),
        ("framework", "Vue", '"vue"'), ("orm", "Mongoose", '"mongoose"'), ("orm", "Prisma", '"prisma"', '"@prisma/client"'), ("orm", "Sequelize", '"sequelize"'), ("orm", "TypeORM", '"typeorm"'),
        ("database", "PostgreSQL", '"pg"', '"postgresql"'), ("database", "MySQL", '"mysql"', '"mysql2"'), ("database", "MongoDB", '"mongodb"'), ("database", "Redis", '"ioredis"', '"redis"'), ("auth_library", "JWT", '"jsonwebtoken"', '"jose"'),
        ("auth_library", "Passport", '"passport"'), ("message_queue", "Bull", '"bull"'), ("message_queue", "RabbitMQ", '"amqplib"', '"rabbitmq"'), ("template_engine", "EJS", '"ejs"'), ("template_engine", "Pug", '"pug"'),
        ("template_engine", "Handlebars", '"handlebars"'), ("build_tool", "Webpack", '"webpack"'), ("build_tool", "Vite", '"vite"'),
    ),
    "Go": (
        ("framework", "Gin", "gin-gonic"), ("framework", "Echo", "echo"), ("framework", "Fiber", "fiber"), ("orm", "GORM", "gorm"), ("database", "PostgreSQL", "postgres"), ("database", "MySQL", "mysql"), ("database", "MongoDB", "mongo"),
        ("database", "Redis", "redis"),
    ),
    "Java": (
        ("framework", "Spring Boot", "spring-boot"), ("orm", "Hibernate", "hibernate"), ("orm", "MyBatis", "mybatis"), ("auth_library", "Spring Security", "spring-security"), ("auth_library", "Apache Shiro", "shiro"),
        ("template_engine", "Thymeleaf", "thymeleaf"), ("message_queue", "Kafka", "kafka"), ("message_queue", "RabbitMQ", "rabbitmq"), ("build_tool", "Maven",),
    ),
    "Ruby": (("framework", "Rails", "rails"), ("orm", "ActiveRecord", "activerecord"), ("auth_library", "Devise", "devise")),
    "PHP": (("framework", "Laravel", "laravel"), ("framework", "Symfony", "symfony"), ("orm", "Doctrine", "doctrine")),
    "Rust": (("framework", "Actix", "actix"), ("framework", "Axum", "axum"), ("framework", "Rocket", "rocket"), ("orm", "Diesel", "diesel"), ("orm", "SQLx", "sqlx")),
}
#: What one manifest alone says; how many files of a listing may tell a language by their ending.
POETRY, FIRST_FILES = ("pyproject.toml", "build_tool", "Poetry", "poetry"), 50


def tech_profile(files: DataFrame) -> DataFrame:
    """Per project and category (language, framework, database, orm, auth_library, template_engine, message_queue, build_tool) the names that its manifests tell, in the order of the tables.

    Manifests are files of these names at the root. A project without manifests of Python is
    one in Python if any of its first files are. Every manifest is read once for all markers.
    """
    rules = [(language, *rule[:2], rule[2:]) for language, own in PARTS.items() for rule in own]
    place = {language: i for i, language in enumerate(PARTS)}
    said = files.filter(F.col("path").isin(*LANGUAGES)).select("project", "path", F.lower(text_or_empty("content")).alias("low")).filter("low <> ''")
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.col("path")]
    told = fixed(said.withColumn("language", language), _n=keyword_counts("low", [*[markers for *_, markers in rules], [POETRY[3]]])).drop("low")
    entry = lambda category, name, order: F.struct(F.lit(category).alias("category"), F.lit(name).alias("name"), F.lit(order).alias("place"))
    held = [F.when((F.col("language") == own) & (F.col("_n")[i] > 0 if markers else F.lit(True)), entry(category, name, i)) for i, (own, category, name, markers) in enumerate(rules)]
    held.append(F.when((F.col("path") == POETRY[0]) & (F.col("_n")[len(rules)] > 0), entry(POETRY[1], POETRY[2], next(i for i, r in enumerate(rules) if r[2] == "Setuptools") - 1)))
    held += [F.when(F.col("language") == own, entry("language", own, i)) for own, i in place.items()]
    by_manifest = told.select("project", F.explode(F.array_compact(F.array(*held))).alias("e")).select("project", "e.*")
    first = top(files.select("project", "ordinal", "path"), ["project"], [F.col("ordinal")], FIRST_FILES).filter(F.col("path").endswith(".py"))
    by_ending = first.select("project", F.lit("language").alias("category"), F.lit("Python").alias("name"), F.lit(0).alias("place"))
    once = by_manifest.unionByName(by_ending).groupBy("project", "category", "name").agg(F.min("place").alias("place"))
    return once.groupBy("project", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("values"))

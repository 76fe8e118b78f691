"""The analysis as one pipeline of DataFrames: scan, parse once, rules, post-processing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.cluster import kept
from treeline.functions import text as T
from treeline.operators import duplicates, post, rules, tree
from treeline.sources import cache
from treeline.sources import files as S
from treeline.sources.config import Config, ConfigError

#: Rules in the order in which their findings stand within a file; options with their defaults and least values.
RULES = ("dead-code-after-return", "deep-nesting", "empty-block", "empty-catch", "empty-function", "long-function", "complex-function", "unused-variable", "promotable-return-type", "windows-script-encoding", "hardcoded-secret", "duplicate-code", "todo-tracker")
BUILT_IN = ("parse-error", "unreadable-file")
OPTIONS = {"deep-nesting": ("maxDepth", 4, 1), "long-function": ("maxStatements", 30, 1), "complex-function": ("maxCognitive", 15, 1), "duplicate-code": ("minLines", 8, 2)}


@dataclass(frozen=True)
class OwnRule:
    """A rule of one's own: a function from files and nodes (and its options by name) to findings; each option
    has a default and a least value."""

    name: str
    find: Callable[..., DataFrame]
    options: tuple[tuple[str, int, int], ...] = ()


def check_options(config: Config, own: tuple[OwnRule, ...] = ()) -> None:
    """Raises ConfigError for unknown rules and options."""
    known = {rule: (OPTIONS[rule],) if rule in OPTIONS else () for rule in (*RULES, *BUILT_IN)} | {r.name: r.options for r in own}
    for rule in (*config.severities, *config.options):
        if rule not in known:
            raise ConfigError(f"unknown rule {rule!r}")
    for rule, given in config.options.items():
        if not known[rule]:
            raise ConfigError(f"{rule} has no options")
        least_of = {name: least for name, _, least in known[rule]}
        for name, v in given.items():
            if name not in least_of:
                raise ConfigError(f"{rule}: unknown option {name!r}")
            least = least_of[name]
            if not isinstance(v, int) or isinstance(v, bool) or v < least:
                raise ConfigError(f"{rule}: {name} must be a whole number of at least {least}")


@dataclass(frozen=True)
class Analysis:
    """What an analysis gives: files, their results, and findings in a table with order keys.

    ``release`` lets go of what is kept for reuse; the frames can still be computed again."""

    files: DataFrame
    results: DataFrame
    findings: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


@dataclass(frozen=True)
class Engine:
    """Builder of analyses. Rules of one's own are added before a configuration that names them."""

    spark: SparkSession
    config: Config = field(default_factory=Config)
    todo: bool = True
    cache_path: str | None = None
    prefixes: tuple[str, ...] = (post.PREFIX,)
    extra: tuple[OwnRule, ...] = ()
    providers: tuple[S.Provider, ...] = ()

    def with_provider(self, provider: S.Provider) -> Engine:
        """A language of one's own, asked before the built-in ones."""
        return replace(self, providers=(*self.providers, provider))

    def with_config(self, config: Config) -> Engine:
        check_options(config, self.extra)
        return replace(self, config=config)

    def with_cache(self, path: str) -> Engine:
        return replace(self, cache_path=path)

    def with_rule(self, name: str, rule: Callable[..., DataFrame], **options: tuple[int, int]) -> Engine:
        """``rule`` takes files, nodes and its options; each option is given as (default, least value)."""
        return replace(self, extra=(*self.extra, OwnRule(name, rule, tuple((k, *v) for k, v in options.items()))))

    def option(self, rule: str) -> int:
        name, default, _ = OPTIONS[rule]
        return self.config.options.get(rule, {}).get(name, default)

    def on(self, rule: str) -> bool:
        return not self.config.disabled(rule) and (rule != "todo-tracker" or self.todo)

    def analyze_path(self, path: str) -> Analysis:
        return self.analyze(S.scan_files(self.spark, path, list(self.config.exclude), self.config.base_dir if self.config.source else None))

    def parse(self, files: DataFrame) -> DataFrame:
        """Parsed files, from the cache where their content is known."""
        if not self.cache_path:
            return kept(S.parse_files(files, self.providers))
        mark = cache.fingerprint({p.name: [p.extensions, p.fingerprint] for p in self.providers})
        missing, hits = cache.split(files.filter("language is not null"), cache.load(self.spark, self.cache_path, mark))
        fresh = S.parse_files(missing, self.providers).join(missing.select(F.col("file").alias("id"), "key"), "id")
        parsed = kept(fresh if hits is None else fresh.unionByName(hits))
        bad = parsed.filter("error is not null").select("key").distinct()
        cache.save(parsed.join(bad, "key", "left_anti"), self.cache_path, mark)
        return parsed.drop("key")

    def analyze(self, files: DataFrame) -> Analysis:
        if self.providers:
            own = T.language_of(F.col("file"), [(p.name, p.extensions) for p in self.providers])
            files = files.withColumn("language", F.coalesce(own, F.col("language")))
        files = kept(files)
        parsed = self.parse(files)
        nodes = kept(S.node_rows(parsed))
        readable = files.filter("source is not null")
        metrics = tree.function_metrics(nodes)
        makers: dict[str, Callable[[], DataFrame]] = {
            "dead-code-after-return": lambda: tree.dead_code_after_return(nodes),
            "deep-nesting": lambda: tree.deep_nesting(nodes, self.option("deep-nesting")),
            "empty-block": lambda: tree.empty_block(nodes),
            "empty-catch": lambda: tree.empty_catch(nodes),
            "empty-function": lambda: tree.empty_function(nodes),
            "long-function": lambda: tree.long_function(nodes, self.option("long-function")),
            "complex-function": lambda: tree.complex_function(metrics, self.option("complex-function")),
            "unused-variable": lambda: tree.unused_variable(S.php_rows(parsed)),
            "promotable-return-type": lambda: tree.promotable_return_type(S.php_rows(parsed)),
            "windows-script-encoding": lambda: rules.windows_script_encoding(readable),
            "hardcoded-secret": lambda: rules.hardcoded_secret(readable),
            "todo-tracker": lambda: rules.todo_tracker(readable),
        }
        parts = [self.shaped(S.parse_errors(parsed), 0, 0), self.shaped(S.unreadable(files), 0, 0)]
        for k, rule in enumerate(RULES):
            if rule in makers and self.on(rule):
                parts.append(self.shaped(makers[rule](), 1, k))
        if self.on("duplicate-code"):
            n = self.option("duplicate-code")
            known = readable.join(S.file_rows(parsed).filter("error is null").select("file"), "file", "left_semi")
            found = duplicates.duplicate_code(known.select("file", "source", "language"), n)
            parts.append(self.shaped(found.withColumn("k1", F.col("line")).withColumn("k2", F.col("end_line")), 2, 0))
        for k, own in enumerate(self.extra):
            if self.on(own.name):
                given = self.config.options.get(own.name, {})
                parts.append(self.shaped(own.find(files, nodes, **{n: given.get(n, default) for n, default, _ in own.options}), 1, len(RULES) + k))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = post.suppress(found, post.suppressions(readable, self.prefixes))
        found = post.override_severity(found, self.config.severities)
        per = metrics.groupBy(F.col("id").alias("file")).agg(F.sort_array(F.collect_list(F.struct("node_id", "name", "line", "cyclomatic", "cognitive", "statements"))).alias("f"))
        functions = F.transform("f", lambda x: F.struct(x["name"].alias("name"), x["line"].alias("line"), x["cyclomatic"].alias("cyclomatic"), x["cognitive"].alias("cognitive"), x["statements"].alias("statements")))
        results = readable.select("file", "language", T.lines_of_code(F.col("source")).alias("lines_of_code")).join(per.select("file", functions.alias("functions")), "file", "left")
        return Analysis(files, results, found, (files, parsed, nodes))

    @staticmethod
    def shaped(df: DataFrame, phase: int, rule_ord: int) -> DataFrame:
        """Findings with all columns and their place in the order."""
        none = F.lit(None)
        fix = F.col("fix") if "fix" in df.columns else none.cast("struct<start_offset:int,end_offset:int,replacement:string>")
        end = F.col("end_line").cast("int") if "end_line" in df.columns else none.cast("int")
        k1 = F.col("k1").cast("int") if "k1" in df.columns else F.col("line").cast("int")
        k2 = F.col("k2").cast("int") if "k2" in df.columns else F.lit(0)
        return df.select("file", F.col("line").cast("int").alias("line"), "rule", "severity", "message", fix.alias("fix"), end.alias("end_line"), F.lit(phase).alias("phase"), F.lit(rule_ord).alias("rule_ord"), k1.alias("k1"), k2.alias("k2"))

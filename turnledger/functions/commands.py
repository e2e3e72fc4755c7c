"""What shell commands do, as column work: class of a command, effects of its statements, and which outputs can be reduced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.session import stored

#: What the leading segment of a command begins with, by class.
FILE_DUMP, SED_DUMP, PYTHON_DUMP = r"^(cat|head|tail|less|more|bat)\b", r"^sed\s+(-n\s+)?['\"]?[0-9,]+p", r"python3?\s+-c\s+.*open\("
TEST = r"^(pytest|python3?\s+-m\s+pytest|npm\s+(run\s+)?test|npx\s+jest|jest|vitest|go\s+test|cargo\s+test|ctest|gradle\w*\s+test|mvn\s+test|rspec|phpunit|tox)\b"
BUILD = r"^(make|cmake|ninja|cargo\s+build|npm\s+run\s+build|npx\s+tsc|tsc|gcc|g\+\+|clang|xcodebuild|gradle|mvn|pio\b|platformio|idf\.py|arduino-cli|swift\s+build|python3?\s+setup\.py)\b"
SEARCH, NET, TRIVIAL = r"^(grep|rg|ripgrep|ag|find|fd|ls|tree|wc|du|file|stat)\b", r"^(curl|wget|http|ping|ssh|scp|rsync)\b", r"^(cd|echo|export|set|source|\.)\b"
#: Test runners anywhere in a command, and the marks of test output and of failures.
RUNNER = r"\b(pytest|jest|vitest|go test|cargo test|npm (run )?test|rspec|phpunit)\b"
TEST_LIKE = r"(?im)(\d+\s+(passed|failed|error|skipped)|test session starts|collected \d+ item|Ran \d+ test|=+\s*(FAILURES|ERRORS|short test summary)|^\s*(PASSED|FAILED)\b|::\w|Creating test database|Destroying test database|System check identified|^OK$|^FAILED \()"
FAILURE = r"(?i)(FAILED|FAILURES|ERROR|Traceback|✗|✘|\bfailed\b|AssertionError)"
#: Programs by what they do to files, filters that turn lines into something else, flags that take the next word, and
#: shell forms that are not looked into.
READERS, SEARCHERS, LISTERS = ("cat", "head", "tail", "less", "more", "bat", "nl"), ("grep", "egrep", "fgrep", "rg", "ripgrep", "ag", "ack"), ("find", "ls", "tree")
RUNNERS = ("python", "python2", "python3", "pytest", "py.test", "tox", "make", "flake8", "black", "isort", "mypy", "pylint", "coverage", "pip", "pip3", "npm", "node", "yarn", "go", "cargo", "ruff", "nox")
SUMMARIZERS = ("wc", "sort", "uniq", "cut", "tr", "jq", "column", "paste", "comm", "md5", "md5sum", "sha1sum", "sha256sum", "xxd", "od", "base64", "tee")
VALUED = ("-n", "-c", "--lines", "--bytes")
COMPLEX = r"`|\$\(|<\(|<<|\bfor\b|\bwhile\b|\bdo\b|\bdone\b|\bxargs\b|\beval\b"


def segment_class(s: Column) -> Column:
    return F.when(s.rlike(FILE_DUMP) | s.rlike(SED_DUMP) | s.rlike(PYTHON_DUMP), "shell_file_dump").when(s.rlike(TEST), "shell_test").when(s.rlike(BUILD), "shell_build").when(s.rlike(r"^git\b"), "shell_git").when(s.rlike(SEARCH), "shell_search").when(s.rlike(NET), "shell_net").otherwise("shell_other")


def bash_class(command: Column) -> Column:
    """Class of the first segment that is not trivial; where it has none, of the first later one that tests, builds, or uses git or net."""
    segments = F.filter(F.transform(F.split(F.coalesce(command, F.lit("")), r"&&|\|\||;|\|"), lambda s: F.trim(s)), lambda s: s != "")
    n = F.size(segments)
    lead = F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(1), n - 1), lambda i: ~F.element_at(segments, i).rlike(TRIVIAL)), F.lit(1)), n)
    classes = F.transform(F.slice(segments, lead, n), segment_class)
    first = F.element_at(classes, 1)
    later = F.try_element_at(F.filter(F.slice(classes, 2, F.greatest(n, F.lit(1))), lambda c: ~c.isin("shell_other", "shell_file_dump", "shell_search")), F.lit(1))
    return F.when(n == 0, "shell_other").when(n == 1, segment_class(F.element_at(segments, 1))).when(first != "shell_other", first).otherwise(F.coalesce(later, F.lit("shell_other")))


def is_test_like(output: Column) -> Column:
    return F.coalesce(output.rlike(TEST_LIKE), F.lit(False))


def has_failure(output: Column) -> Column:
    return F.coalesce(output.rlike(FAILURE), F.lit(False))


def reducer_for(tool: Column, command: Column, kind: Column) -> Column:
    """The reducer of an output: tests, grep, git, logs or generic."""
    cmd = F.coalesce(command, F.lit(""))
    return (
        F.when((kind == "test_result") | cmd.rlike(RUNNER), "tests").when((kind == "search_result") | tool.isin("Grep", "Glob"), "grep")
        .when((tool == "Bash") & F.trim(cmd).startswith("git"), "git").when((kind == "log") | (tool == "Bash"), "logs").otherwise("generic")
    )


def norm_parts(path: Column) -> Column:
    """A path without ``.`` and empty parts, ``a/..`` taken out."""
    def step(done: Column, p: Column) -> Column:
        back = (p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when((p == "") | (p == "."), done).when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))


def statements(commands: DataFrame) -> DataFrame:
    """(id, idx, stmt, sep): the statements of each command (id, command) in order and the separator after each; separators inside
    quotes part nothing, and pipes stay inside a statement."""
    pieces = F.regexp_extract_all("command", F.lit(r"('[^']*'|\"[^\"]*\"|&&|\|\||;|(?<!>)&(?!>)|[^'\";&|]+|.)"), F.lit(1))
    p = commands.select("id", F.posexplode(pieces).alias("at", "piece")).withColumn("cut", F.col("piece").isin("&&", "||", ";", "&"))
    w = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("no", F.coalesce(F.sum(F.col("cut").cast("int")).over(w), F.lit(0)))
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("cut"), F.struct("at", "piece")))), lambda x: x["piece"]), ""))
    s = p.groupBy("id", "no").agg(text.alias("stmt"), F.max(F.when(F.col("cut"), F.col("piece"))).alias("sep")).filter("stmt <> ''")
    return s.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("no")) - 1).alias("idx"), "stmt", "sep")


def words_of(stmt: Column) -> Column:
    """The words of a statement without their quotes; redirections of the error output are dropped."""
    plain = F.regexp_replace(F.concat(F.lit(" "), stmt), r"\s\d*>&\d+|\s\d+>>?\s*[^\s|;&<>]+", "")
    words = F.regexp_extract_all(plain, F.lit(r"((?:'[^']*'|\"[^\"]*\"|[^\s'\"])+)"), F.lit(1))
    return F.transform(words, lambda w: F.regexp_replace(w, r"['\"]", ""))


def effects_of(stmt: Column) -> Column:
    """array<struct<kind, path, representation>> of one statement. What is not surely known is one effect of kind unknown."""
    words = words_of(stmt)
    bar = F.array_position(words, "|")
    piped, head = bar > 0, F.when(bar > 0, F.slice(words, F.lit(1), F.greatest(bar.cast("int") - 1, F.lit(0)))).otherwise(words)
    tail = F.try_element_at(words, (F.size(words) - F.array_position(F.reverse(words), "|") + 2).cast("int"))
    prog, rest = F.try_element_at(head, F.lit(1)), F.slice(head, F.lit(2), F.greatest(F.size(head), F.lit(1)))
    args = F.filter(rest, lambda w: ~w.startswith("-"))
    has = lambda pattern: F.exists(rest, lambda w: w.rlike(pattern))
    last = lambda xs: F.coalesce(F.try_element_at(xs, F.lit(-1)), F.lit("."))
    effect = lambda kind, path=None, rep=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if path is None else path).alias("path"), (F.lit(None).cast("string") if rep is None else rep).alias("representation"))
    unknown, none = F.array(effect("unknown")), F.array().cast("array<struct<kind:string,path:string,representation:string>>")
    natural = lambda rep: F.when(piped & tail.isin(*SUMMARIZERS), "derived").when(piped & (F.lit(rep) == "file"), "search").otherwise(rep)
    reads = lambda xs, rep: F.transform(xs, lambda p: effect("read", p, natural(rep)))
    edits = lambda xs: F.transform(xs, lambda p: effect("edit", p))
    or_unknown = lambda xs: F.when(F.size(xs) == 0, unknown).otherwise(xs)
    scope = lambda a: F.when(F.exists(a, lambda w: w.rlike(r"^(-e|-f|--regexp|--file)")), last(F.filter(a, lambda w: ~w.startswith("-")))).otherwise(last(F.slice(F.filter(a, lambda w: ~w.startswith("-")), F.lit(2), F.greatest(F.size(a), F.lit(1)))))
    at = lambda i: F.coalesce(F.try_element_at(rest, i), F.lit(""))
    operand = F.filter(F.sequence(F.lit(1), F.greatest(F.size(rest), F.lit(1))), lambda i: (at(i) != "") & ~at(i).startswith("-") & ~((i > 1) & at(F.greatest(i - 1, F.lit(1))).isin(*VALUED)))
    files = F.transform(operand, at)
    first_flag = F.coalesce(F.nullif(F.array_position(F.transform(rest, lambda w: w.startswith("-")), True), F.lit(0)), F.size(rest) + 1).cast("int")
    redirect = F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.element_at(words, i).isin(">", ">>", "1>", "1>>", "&>", "&>>")), F.lit(1))
    unquoted = F.regexp_replace(stmt, r"'[^']*'|\"[^\"]*\"", "")
    blob = F.regexp_extract(F.coalesce(F.try_element_at(rest, F.lit(2)), F.lit("")), r"^[^:]+:(.+)$", 1)
    return (
        F.when(unquoted.rlike(r"['\"]"), unknown).when(F.size(words) == 0, none)
        .when(unquoted.contains(">") & redirect.isNotNull(), edits(F.array(F.try_element_at(words, redirect + 1)))).when(prog == "cd", none).when(prog.isNull(), unknown)
        .when(prog.isin(*RUNNERS) | prog.endswith(".py"), F.array(effect("execution"))).when(prog.isin(*READERS), or_unknown(reads(files, "file")))
        .when(prog.isin(*SEARCHERS), F.array(effect("read", scope(rest), natural("search")))).when((prog == "git") & (F.try_element_at(rest, F.lit(1)) == "grep"), F.array(effect("read", scope(F.slice(rest, F.lit(2), F.greatest(F.size(rest), F.lit(1)))), natural("search"))))
        .when((prog == "find") & has(r"^-(delete|exec|execdir|ok)$"), unknown).when(prog == "find", F.array(effect("read", last(F.slice(rest, F.lit(1), first_flag - 1)), natural("path_listing")))).when(prog.isin(*LISTERS), F.array(effect("read", last(args), natural("path_listing"))))
        .when((prog == "sed") & (F.size(args) > 0) & has(r"^-i"), edits(F.array(last(args)))).when((prog == "sed") & (F.size(args) > 0) & has(r"^-n"), F.array(effect("read", last(args), natural("file")))).when(prog == "tee", or_unknown(edits(args)))
        .when((prog == "cp") & (F.size(args) >= 2), edits(F.array(last(args)))).when((prog == "mv") & (F.size(args) >= 2), edits(F.array(F.element_at(args, 1), last(args)))).when(prog == "rm", or_unknown(edits(args)))
        .when((prog == "git") & (F.try_element_at(rest, F.lit(1)) == "show") & (blob != ""), F.array(effect("read", blob, F.lit("git_blob")))).otherwise(unknown)
    )


def command_effects(commands: DataFrame) -> DataFrame:
    """(id, idx, kind, path, representation, certain, attributable) of each effect of commands (id, command).

    An effect is certain if its statement runs whatever happens before it: it is the first, follows ``;``, or follows ``&&`` after
    a certain ``cd``, and nothing is in the background. A certain ``cd`` moves later relative paths. A read is attributable if no
    execution, unknown or uncertain effect shares its command. Words are split at quotes and spaces only, so commands with
    substitutions, loops or here-documents, or unmatched quotes, are unknown as a whole: an odd command never invents a read.

    Commands come again and again, so each different one is worked out once and its effects are joined back.
    """
    texts = stored(commands.filter("command is not null").select("command").distinct().withColumn("text_id", F.monotonically_increasing_id()), "commands")
    found = effects_by_text(texts.withColumnRenamed("text_id", "id")).withColumnRenamed("id", "text_id")
    return commands.select("id", "command").join(texts, "command").join(found, "text_id").drop("text_id", "command")


def effects_by_text(commands: DataFrame) -> DataFrame:
    """``command_effects`` of commands that all differ."""
    odd = F.col("command").rlike(COMPLEX) | F.regexp_replace("command", r"'[^']*'|\"[^\"]*\"", "").rlike(r"['\"]")
    plain = statements(commands.filter(~odd))
    w = Window.partitionBy("id").orderBy("idx")
    is_cd = F.col("stmt").rlike(r"^cd(\s|$)")
    s = plain.withColumns({"before": F.lag("sep").over(w), "after_cd": F.lag(is_cd).over(w), "effects": effects_of(F.col("stmt"))})
    fresh = (F.col("idx") == 0) | (F.col("before") == ";")
    s = s.withColumn("run", F.sum(fresh.cast("int")).over(w)).withColumn("loose", (F.coalesce(F.col("sep") == "&", F.lit(False)) | ~(fresh | ((F.col("before") == "&&") & F.col("after_cd")))).cast("int"))
    s = s.withColumn("certain", F.max("loose").over(Window.partitionBy("id", "run").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) == 0)
    goes = F.when(is_cd & F.col("certain"), F.regexp_extract("stmt", r"^cd\s+([^-\s]\S*)", 1))
    moves = F.collect_list(F.nullif(goes, F.lit(""))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    absolute = F.coalesce(F.array_max(F.transform(F.filter(F.sequence(F.lit(0), F.size("moves")), lambda i: (i > 0) & F.coalesce(F.try_element_at(F.col("moves"), F.greatest(i, F.lit(1))), F.lit("")).startswith("/")), lambda i: i)), F.lit(1))
    s = s.withColumn("moves", moves).withColumn("cwd", F.when(F.size("moves") > 0, F.array_join(F.slice("moves", absolute, F.greatest(F.size("moves"), F.lit(1))), "/")))
    e = s.select("id", "idx", "certain", "cwd", F.explode("effects").alias("e")).select("id", "idx", "certain", "cwd", "e.*").unionByName(commands.filter(odd).select("id", F.lit(0).alias("idx"), F.lit(True).alias("certain"), F.lit("unknown").alias("kind")), allowMissingColumns=True)
    moved = F.when(F.col("path").isNotNull() & F.col("cwd").isNotNull() & ~F.col("path").startswith("/"), norm_parts(F.concat_ws("/", "cwd", "path"))).otherwise(F.col("path"))
    spoiled = F.max(((F.col("kind").isin("execution", "unknown")) | ~F.col("certain")).cast("int")).over(Window.partitionBy("id")) == 1
    return e.select("id", "idx", "kind", moved.alias("path"), "representation", "certain", ((F.col("kind") == "read") & ~spoiled).alias("attributable"))


def routes(calls: DataFrame, effects: DataFrame) -> DataFrame:
    """(id, reduce, representation, reason) of calls (id, tool, command): whether the output is a search or listing that can be
    reduced. ``effects`` are those of the commands; only commands whose every effect is an attributable search or listing count."""
    bad = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")) == 1
    own = effects.groupBy("id").agg(
        bad(F.col("kind") == "execution").alias("runs"), bad((F.col("kind") == "unknown") | ~F.col("certain")).alias("odd"), bad(F.col("kind") == "edit").alias("edits"),
        bad((F.col("kind") == "read") & ~F.col("representation").isin("search", "path_listing")).alias("other"), bad(F.col("representation") == "search").alias("searches"), bad(F.col("kind") == "read").alias("reads"),
    )
    shell = F.col("tool") == "Bash"
    reason = (
        F.when(F.col("tool") == "Grep", "native_search").when(F.col("tool") == "Glob", "native_listing").when(~shell, "other_tool").when(F.trim(F.coalesce("command", F.lit(""))) == "", "no_command")
        .when(F.col("runs"), "execution").when(F.col("odd"), "uncertain").when(~F.coalesce("reads", F.lit(False)), "no_read").when(F.col("other"), "other_representation").when(F.col("edits"), "mixed").otherwise("shell_read")
    )
    r = calls.join(own, "id", "left").withColumn("reason", reason).withColumn("reduce", F.col("reason").isin("native_search", "native_listing", "shell_read"))
    rep = F.when(F.col("reason") == "native_listing", "path_listing").when(F.col("reason") == "native_search", "search").when(F.col("reduce"), F.when(F.col("searches"), "search").otherwise("path_listing"))
    return r.select("id", "reduce", rep.alias("representation"), "reason")

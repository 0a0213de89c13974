"""Commands and calls: parsing lines and JSON requests, answering them in order, and the numeric-code protocol."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.asof import last_before

_ARITY = {"get": 2, "set": 3, "rm": 2, "remove": 2, "exit": 1, "Exit": 1}
NOT_FOUND, UNKNOWN, NO_COMMAND, NO_JSON, NO_WRITE = "key not found", "unknown command", "no command", "not a JSON request", "a write needs a key, and a put needs a value"


def parse(line: Column) -> Column:
    """struct(op, key, value, error) of a command line.

    The line is trimmed and cut at single spaces, so an empty line is an unknown command and a doubled space a wrong
    number of words. Only built-in expressions.
    """
    words = F.split(F.trim(line), " ", -1)
    name, n = words[0], F.size(words)
    known = F.create_map(*(F.lit(x) for pair in _ARITY.items() for x in pair))
    arity = F.try_element_at(known, name)
    said = F.concat(F.lit("wrong number of arguments: "), arity.cast("string"), F.lit(" expected, "), n.cast("string"), F.lit(" given"))
    error = F.when(line.isNull(), NO_COMMAND).when(arity.isNull(), UNKNOWN).when(arity != n, said)
    op = F.when(name == "remove", "rm").when(name == "Exit", "exit").otherwise(name)
    ok = error.isNull()
    return F.struct(
        F.when(ok, op).alias("op"),
        F.when(ok & (arity > 1), F.get(words, 1)).alias("key"),
        F.when(ok & (arity > 2), F.get(words, 2)).alias("value"),
        error.alias("error"),
    )


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once a row: the optimizer puts a copy of an expression wherever it is named, but not
    of a lambda's variable."""
    return F.get(F.transform(F.array(x), f), 0)


def parse_json(line: Column) -> Column:
    """struct(op, key, value, error) of a request in JSON: {"command": {"Get": k}}, {"Set": [k, v]}, {"Remove": k} or "Exit".

    A line is parsed once, and its command once. Failing to parse takes far longer than parsing, so two sorts aren't tried:
    lines with neither a closing brace nor a second field, from which nothing can be read, and the command "Exit".
    """

    def request(raw: Column, c: Column) -> Column:
        pair = F.size(c["Set"]) == 2
        op = F.when(raw == "Exit", "exit").when(c["Get"].isNotNull(), "get").when(pair, "set").when(c["Remove"].isNotNull(), "rm")
        key = F.coalesce(c["Get"], F.when(pair, F.get(c["Set"], 0)), c["Remove"])
        error = F.when(op.isNull(), F.when(line.isNull() | (F.trim(line) == ""), NO_COMMAND).otherwise(NO_JSON))
        return F.struct(op.alias("op"), key.alias("key"), F.when(op == "set", F.get(c["Set"], 1)).alias("value"), error.alias("error"))

    parsed = lambda raw: _once(F.from_json(F.when(raw != "Exit", raw), "Get string, Set array<string>, Remove string"), lambda c: request(raw, c))
    return _once(F.from_json(F.when(F.contains(line, F.lit("}")) | line.like("%:%:%"), line), "command string")["command"], parsed)


def _in_order(requests: DataFrame, state: DataFrame, put: Column, delete: Column, span: int) -> DataFrame:
    """Adds ``v``: what a read of the key finds, which is the last write before it, else the snapshot."""
    valid = F.length("key") > 0
    wrote = F.when(put & valid & (F.length("value") > 0), F.struct(F.col("value").alias("v"))).when(delete & valid, F.struct(F.lit(None).cast("string").alias("v")))
    stored = state.select(F.col("k").alias("key"), F.struct(F.col("v").alias("v")).alias("v"))
    d = last_before(requests, "key", "seq", wrote, "__found", span, stored)
    return d.withColumn("v", F.col("__found")["v"]).drop("__found")


def serve(commands: DataFrame, state: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Commands (seq, op, key, value, error) with the answer: the value, 'key not found', 'ok', 'bye' or the error.

    Commands take effect in the order of ``seq``, as if each waited for the one before: a get sees the last set or rm of
    its key before it, else the snapshot ``state`` (k, v). All are answered by one as-of lookup
    that begins with the snapshot.
    """
    op = F.col("op")
    found = _in_order(commands, state, op == "set", op == "rm", span)
    refused = op.isin("set", "rm") & (F.length("key") == 0) | (op == "set") & (F.length("value") == 0)
    said = F.when(F.col("error").isNotNull(), F.col("error")).when(refused, NO_WRITE).when(op == "get", F.coalesce("v", F.lit(NOT_FOUND))).when(op == "exit", "bye").otherwise("ok")
    failed = F.col("error").isNotNull() | F.coalesce(refused, F.lit(False)) | ((op == "get") & F.col("v").isNull())
    return found.select("seq", "op", "key", said.alias("message"), F.coalesce(~failed, F.lit(False)).alias("ok"))


def answer_json(answers: DataFrame) -> DataFrame:
    """(seq, line): the answers of :func:`serve` as JSON lines; an exit has none."""
    hit = F.col("ok") & (F.col("op") == "get")
    code, message = F.when(F.col("ok"), "OK").otherwise("Err").alias("code"), F.when(F.col("message") == "ok", "Ok").otherwise(F.col("message")).alias("message")
    value = F.to_json(F.struct(code, F.col("message"), F.struct(F.struct(F.col("message").alias("VString")).alias("value")).alias("value")))
    empty = F.to_json(F.struct(code, message, F.struct(F.lit("Empty").alias("value")).alias("value")))
    return answers.filter("op is null or op <> 'exit'").select("seq", F.when(hit, value).otherwise(empty).alias("line"))


def mutations(commands: DataFrame) -> DataFrame:
    """The set and rm commands that are valid as batch operations (seq, op, k, v)."""
    fine = "op in ('set', 'rm') and length(key) > 0 and (op = 'rm' or length(value) > 0)"
    return commands.filter(fine).select("seq", F.when(F.col("op") == "set", "put").otherwise("del").alias("op"), F.col("key").alias("k"), F.col("value").alias("v"))


def call(requests: DataFrame, state: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Calls (seq, code, key, value): 1 get, 2 put, 3 delete, in the order of ``seq``, as :func:`serve`.

    Result codes: 1 ok, 2 missing, 3 error (an unknown code, an empty key or a put without a value).
    """
    code, key = F.col("code"), F.coalesce(F.length(F.col("key").cast("string")), F.lit(0)) > 0
    found = _in_order(requests, state, code == 2, code == 3, span)
    fails = ~code.isin(1, 2, 3) | code.isNull() | ((code > 1) & ~key) | ((code == 2) & (F.coalesce(F.length("value"), F.lit(0)) == 0))
    result = F.when(fails, 3).when((code == 1) & F.col("v").isNull(), 2).otherwise(1)
    return found.select("seq", "code", "key", result.alias("result"), F.when(code == 1, F.coalesce("v", F.lit(NOT_FOUND))).when(fails, "failed").otherwise("ok").alias("message"))


def call_mutations(requests: DataFrame) -> DataFrame:
    """The puts and deletes among calls that are valid as batch operations (seq, op, k, v)."""
    op = F.when(F.col("code") == 2, "set").when(F.col("code") == 3, "rm")
    return mutations(requests.select("seq", op.alias("op"), F.col("key").cast("string").alias("key"), "value"))

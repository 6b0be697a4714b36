"""Honeytokens: made-up secrets, the manifest that knows them, and writing them out.

A kind is a template whose blanks are filled with letters of a digest of seed, kind, number and place, so the same
tokens come out every time, here, in Spark and in any SQL engine that has SHA-256.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan import rules as R
from veilscan.schemas import HONEYTOKENS

HEX = "0123456789abcdef"
#: Each alphabet has a letter for each hexadecimal digit.  A blank is written <alphabet:length>, of 64 letters at most.
ALPHABETS = {
    "upper": "A7C2EFH9KLN4QRTX",
    "first": "bDfG3jKmPr5tVxZ8",
    "second": "aCe1HiLn6QsUw9yT",
}
#: What a decoy of a kind looks like.
TEMPLATES = {
    "AWS_ACCESS_KEY": "AKIA<upper:16>",
    "GITHUB_TOKEN": "ghp_<first:18><second:18>",
    "STRIPE_KEY": "sk_live_<first:14><second:14>",
    "GENERIC_API_KEY": "export service\n  api key: <first:24><second:20>\n  ask the data team before use\n",
    "ENV_FILE": "# staging, do not commit\nAPP_SECRET=<first:22><second:22>\nMAIL_PASSWORD=<second:9><first:9>\nPAYMENT_KEY=sk_live_<first:14><second:14>\nCLOUD_KEY=AKIA<upper:16>\n",
    "SSH_PRIVATE_KEY": "-----BEGIN OPENSSH PRIVATE KEY-----\n<first:35><second:35>\n<second:35><first:35>\n<first:20><second:21>=\n-----END OPENSSH PRIVATE KEY-----\n",
    "JSON_CREDENTIALS": '{"service": "ledger", "login": "svc-<second:6>", "password": "<first:11><second:11>", "token": "ghp_<first:18><second:18>"}\n',
    "MIXED_API_KEYS": "forge   ghp_<first:18><second:18>\nmodels  sk-<first:16><second:16>\ncloud   AKIA<upper:16>\n",
    "CONFIG_INI": "[replica]\nhost = 10.0.0.7\nuser = reader\npassword = <first:10><second:10>\n",
}
_BLANK = re.compile(r"<(\w+):(\d+)>")


def pieces(kind: str) -> list[str | tuple[str, int]]:
    """A kind's template cut into its texts and blanks (alphabet, length)."""
    out: list[str | tuple[str, int]] = []
    at = 0
    for m in _BLANK.finditer(TEMPLATES[kind]):
        out += [TEMPLATES[kind][at : m.start()], (ALPHABETS[m[1]], int(m[2]))]
        at = m.end()
    return [x for x in [*out, TEMPLATES[kind][at:]] if x]


def content(kind: str, seed: int, number: int) -> str:
    def filled(place: int, piece: str | tuple[str, int]) -> str:
        if isinstance(piece, str):
            return piece
        digest = hashlib.sha256(f"{seed}/{kind}/{number}/{place}".encode()).hexdigest()
        return digest[: piece[1]].translate(str.maketrans(HEX, piece[0]))

    return "".join(filled(k, x) for k, x in enumerate(pieces(kind)))


def make_tokens(home: str, seed: int) -> list[dict]:
    """The deployments with content, id and digest."""
    out = []
    for k, (place, kind) in enumerate(R.DEPLOYMENTS):
        text = content(kind, seed, k)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out.append({"path": f"{home.rstrip('/')}/{place}", "token_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{seed}/{place}/{digest}")), "token_type": kind, "content": text, "content_hash": digest})
    return out


def deploy(home: str, seed: int) -> list[dict]:
    """Write the tokens below ``home``; a file that is there already is never overwritten and not reported."""
    written = []
    for token in make_tokens(home, seed):
        os.makedirs(os.path.dirname(token["path"]), exist_ok=True)
        try:
            with open(token["path"], "x", encoding="utf-8") as f:
                f.write(token["content"])
        except FileExistsError:
            continue
        written.append(token)
    return written


def manifest(spark: SparkSession, tokens: list[dict]) -> DataFrame:
    """The manifest as a table; contents are not in it."""
    rows = [(t["path"], t["token_id"], t["token_type"], t["content_hash"]) for t in tokens]
    df = spark.createDataFrame(rows, "path string, token_id string, token_type string, content_hash string")
    return df.select("path", "token_id", "token_type", F.current_timestamp().alias("deployed_at"), "content_hash")


def write_manifest(tokens: DataFrame, path: str, key: str) -> None:
    """Each row as JSON, encrypted by AES in GCM mode, replacing what was there."""
    sealed = F.aes_encrypt(F.to_json(F.struct(*tokens.columns)).cast("binary"), F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM"))
    tokens.select(F.base64(sealed).alias("row")).write.mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows that the key opens; an empty manifest where there is none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], HONEYTOKENS)
    opened = F.try_aes_decrypt(F.unbase64("row"), F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM")).cast("string")
    return rows.select(F.from_json(opened, HONEYTOKENS).alias("t")).where("t.path is not null").select("t.*")


def synthetic_tokens(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Secrets of all kinds in turn as a table (token_no, token_type, content), made inside the JVM for any ``n``."""

    def filled(kind: str, place: int, piece: str | tuple[str, int]) -> F.Column:
        if isinstance(piece, str):
            return F.lit(piece)
        digest = F.sha2(F.concat(F.lit(f"{seed}/{kind}/"), F.col("id").cast("string"), F.lit(f"/{place}")), 256)
        return F.translate(F.left(digest, F.lit(piece[1])), HEX, piece[0])

    names = list(TEMPLATES)
    turn = (F.col("id") % len(names)).cast("int")
    text = F.lit(None).cast("string")
    for i, kind in enumerate(names):
        text = F.when(turn == i, F.concat(*(filled(kind, k, x) for k, x in enumerate(pieces(kind))))).otherwise(text)
    return spark.range(n).select(F.col("id").alias("token_no"), F.element_at(F.array(*map(F.lit, names)), turn + 1).alias("token_type"), text.alias("content"))

"""Which commands are noise: at ingest, in ranking and in clean-up. The three tests differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echolith.functions.text import first_token, trim_unicode

#: The name of the tool itself, whose own calls are no history.
PRODUCT = "echolith"

# Words that say nothing about what was done.
NOISE_WORDS = ["history", "clear", "exit", "logout", "reset"]
CONTROL_WORDS = ["exit", "logout", "clear", "reset", "history", "true", "false", ":", "source", "."]
NAVIGATION_WORDS = ["cd", "pushd", "popd"]
ENVIRONMENT_WORDS = ["export", "unset", "set", "alias", "unalias", "eval"]
SECRET_MARKS = ["password=", "passwd=", "secret=", "token=", "api_key=", "apikey="]


def _own(token: Column, product: str) -> Column:
    return (token == product) | F.startswith(token, F.lit(f"{product}-"))


def is_internal(command: Column | str, product: str = PRODUCT) -> Column:
    """Calls of the tool itself and noise, by the first token; false for a blank command."""
    token = first_token(command)
    return F.coalesce(_own(token, product) | token.isin(NOISE_WORDS), F.lit(False))


def should_ingest(command: Column | str, product: str = PRODUCT) -> Column:
    """Whether a command is worth keeping; false for null."""
    bare = trim_unicode(command)
    token = first_token(command)
    small = F.lower(bare)
    secret = F.lit(False)
    for mark in SECRET_MARKS:
        secret = secret | F.contains(small, F.lit(mark))
    kept = (F.octet_length(bare) > 1) & ~_own(token, product) & ~token.isin(CONTROL_WORDS + NAVIGATION_WORDS + ENVIRONMENT_WORDS) & ~secret
    return F.coalesce(kept, F.lit(False))


def cleaned_away(normalized: Column | str, product: str = PRODUCT) -> Column:
    """What the clean-up of internal rows deletes: the noise words only as the whole text."""
    text = F.col(normalized) if isinstance(normalized, str) else normalized
    small = F.lower(text)
    # pattern tests ignore ASCII case, the test for the bare name does not
    return (
        F.startswith(small, F.lit(f"{product} ")) | F.startswith(small, F.lit(f"{product}-")) | (text == product) | F.lower(F.trim(text)).isin(NOISE_WORDS)
    )

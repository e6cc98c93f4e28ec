"""Reading the Authorization header under the three rules the service applies.

Each rule is a few patterns over the whole header, tried most frequent first. Only the first blank
separates scheme and token; later blanks belong to the token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a header may hold to be read as text, and the one scheme.
_CHAR = r"[\x20-\x7E\t]"
_TEXT = rf"^{_CHAR}*\z"
_BEARER_TOKEN = rf"^Bearer {_CHAR}+\z"
_BEARER = rf"^Bearer {_CHAR}*\z"
_OTHER_SCHEME = rf"^(?!Bearer ){_CHAR}* {_CHAR}*\z"


def has_grpc_token(header: Column) -> Column:
    return header.rlike(_BEARER_TOKEN)


def grpc_header_outcome(header: Column) -> Column:
    return (
        F.when(has_grpc_token(header), "ok")
        .when(header.isNull(), "missing")
        .when(header.rlike(_OTHER_SCHEME), "bad_scheme")
        .otherwise("invalid")
    )


def grpc_token(header: Column) -> Column:
    """The bearer token, null unless the header passes the gRPC rule."""
    return F.when(has_grpc_token(header), F.substring(header, F.lit(len("Bearer ") + 1), F.length(header)))


def callback_header_outcome(header: Column) -> Column:
    """Unlike the gRPC rule, an empty token passes."""
    return (
        F.when(header.rlike(_BEARER), "ok")
        .when(header.rlike(_TEXT) | header.isNull(), "unauthorized")
        .otherwise("bad_request")
    )


def user_header_outcome(header: Column) -> Column:
    """Whether there is a token to decode; an empty one counts."""
    return (
        F.when(header.rlike(_BEARER), "token")
        .when(header.rlike(_TEXT) | header.isNull(), "no_token")
        .otherwise("invalid")
    )

from .core import (  # noqa: F401
    clip,
    grade,
    h16,
    md5_key,
    rnd,
    trunc_int,
    weekday0,
)

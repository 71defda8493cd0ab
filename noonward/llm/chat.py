"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, and its own text as the only part to
train on. Turns that follow the last assistant turn (or all, if there is none) end a further example without a
trained part, so that nothing of a conversation is lost.

A turn reads `<turn>role\\ntext</turn>\\n`. Inside texts a backslash is put after the `<` of `<turn` and `</turn`
(also where backslashes stand there already), and taken out again on reading; roles have `%`, line ends and `<`
written as percent codes. So neither control string can occur inside a turn.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"))


def escaped(text) -> F.Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text) -> F.Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def escaped_role(role) -> F.Column:
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescaped_role(role) -> F.Column:
    for plain, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def expand(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Examples of the conversations in `turns` (conv_id, turn, role, text; other columns are not used).

    One row per assistant turn, numbered from 1 by `example`: text (context and reply), loss_start and loss_chars
    (the reply's text, in code points from 0), n_turns, and is_last. The untrained rest has loss_chars null. A
    missing role or text is empty; turns of equal number go by role, then text, and repeated rows are turns of
    their own. Rows without a conv_id form one conversation. A conversation's turns must fit in memory.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    row = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    head = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escaped_role(t.role), F.lit("\n")))
    body = F.transform("turns", lambda t: escaped(t.text))
    is_reply = F.transform("turns", lambda t: t.role == trained_role)
    parts = grouped.select("conv_id", head.alias("heads"), body.alias("bodies"), is_reply.alias("replies"))
    numbers = F.sequence(F.lit(1), F.size("replies"))
    ends = F.filter(numbers, lambda i: F.element_at("replies", i) | (i == F.size("replies")))
    each = parts.select("conv_id", "heads", "bodies", "replies", F.posexplode(ends).alias("at", "n_turns"))
    before = F.slice("heads", 1, F.col("n_turns") - 1), F.slice("bodies", 1, F.col("n_turns") - 1)
    context = F.array_join(F.zip_with(*before, lambda h, b: F.concat(h, b, F.lit(CLOSE))), "")
    own_head, own_body = (F.element_at(c, F.col("n_turns")) for c in ("heads", "bodies"))
    trained = F.element_at("replies", F.col("n_turns"))
    made = each.select(
        "conv_id",
        (F.col("at") + 1).alias("example"),
        F.concat(context, own_head).alias("lead"),
        own_body.alias("reply"),
        "n_turns",
        trained.alias("trained"),
        (F.col("n_turns") == F.size("replies")).alias("is_last"),
    )
    return made.select(
        "conv_id",
        "example",
        F.concat("lead", "reply", F.lit(CLOSE)).alias("text"),
        F.when(F.col("trained"), F.length("lead")).alias("loss_start"),
        F.when(F.col("trained"), F.length("reply")).alias("loss_chars"),
        "n_turns",
        "is_last",
    )


def turns_of(text) -> F.Column:
    """The turns (role, text) that a formatted text holds."""
    cut = F.split(text, "</turn>\n", -1)
    whole = F.slice(cut, 1, F.size(cut) - 1)

    def parse(part):
        role = F.substring_index(F.substr(part, F.lit(len(OPEN) + 1)), "\n", 1)
        body = F.substr(part, F.length(role) + F.lit(len(OPEN) + 2))
        return F.struct(unescaped_role(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(whole, parse)


def trained_text(example) -> F.Column:
    """The text under an example's loss mask; null where nothing is trained."""
    return unescaped(F.substr(F.col(f"{example}text"), F.col(f"{example}loss_start") + 1, F.col(f"{example}loss_chars")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say: turns (from the longest), trained texts in order, characters."""
    row = F.struct("example", trained_text("").alias("text"))
    return examples.groupBy("conv_id").agg(
        F.max(F.when(F.col("is_last"), F.col("text"))).alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("loss_chars").isNotNull(), row))).alias("trained"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    ).select("conv_id", turns_of(F.col("whole")).alias("turns"), F.col("trained.text").alias("trained"), "formatted_chars")

"""Chat messages to one prompt string."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How a message is written and which roles are known.

    ``opening`` holds ``{role}``; ``generation`` is put after the last message to ask for a reply.
    """

    opening: str = "<|{role}|>\n"
    closing: str = "<|end|>\n"
    generation: str = "<|assistant|>\n"
    roles: tuple[str, ...] = ("system", "user", "assistant")


def render_chat(
    messages: Column, fallback: Column | None = None, template: ChatTemplate = ChatTemplate()
) -> Column:
    """Render an ``array<struct<role, text>>`` as one prompt ending in the generation suffix.

    An empty list, an unknown role or a missing text cannot be rendered: then ``fallback``
    (the raw prompt) is used.
    """
    before, after = template.opening.split("{role}")

    def line(message: Column) -> Column:
        known = message["role"].isin(*template.roles)
        text = F.concat(
            F.lit(before), message["role"], F.lit(after), message["text"], F.lit(template.closing)
        )
        return F.when(known, text)

    lines = F.transform(messages, line)
    usable = (F.size(messages) > 0) & ~F.exists(lines, lambda x: x.isNull())
    rendered = F.when(usable, F.concat(F.array_join(lines, ""), F.lit(template.generation)))
    return rendered if fallback is None else F.coalesce(rendered, fallback)

"""Hook payloads: one JSON object a row, its aliases promoted, its names made canonical, and the event it goes to.

Everything stays in JSON functions of the JVM. A field's presence counts, not its value: a JSON null is present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.semistruct import promoted, single_object

#: The fields with their native names in order of preference.
ALIASES = {
    "session_id": ["conversation_id", "sessionId", "sessionID"],
    "transcript_path": ["transcriptPath"],
    "hook_event_name": ["hookEventName"],
    "turn_id": ["turnId", "turnID"],
    "stop_hook_active": ["stopHookActive"],
    "last_assistant_message": ["prompt_response", "lastAssistantMessage"],
    "tool_name": ["toolName"],
    "tool_use_id": ["tool_call_id", "toolUseId", "toolUseID", "toolCallId", "toolCallID"],
    "tool_input": ["toolInput"],
    "tool_response": ["tool_result", "tool_output", "toolResponse", "toolOutput"],
    "notification_type": ["notificationType"],
}
#: What the nested object gives to the payload, by field the nested name.
NESTED = {"prompt": "user_message", "turn_id": "turn_id", "tool_use_id": "tool_call_id", "tool_response": "result"}
#: The events that are dispatched, and the canonical name of the shell tool.
EVENTS = ["SessionStart", "UserPromptSubmit", "PreToolUse", "PostToolUse", "PostToolUseFailure", "PermissionRequest", "Notification", "Stop", "SessionEnd"]
SHELL = "Bash"


def with_nested(json: Column, nested: Column, name: str, inner: str) -> Column:
    """The value of name, of its aliases, or of inner in the nested object, if none of them is present."""
    outer = [name, *ALIASES.get(name, [])]
    keys = F.json_object_keys(json)
    here = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in outer]))
    return F.when(here, promoted(json, name, outer[1:])).otherwise(promoted(nested, inner, []))


def canonical(value: Column, native: dict[str, str]) -> Column:
    """The canonical name of a native one; a canonical or unknown name stays."""
    if not native:
        return value
    names = F.create_map(*[F.lit(x) for kv in native.items() for x in kv])
    return F.coalesce(F.element_at(names, value), value)


def normalize(payloads: DataFrame, events: dict[str, str] | None = None, shell: str = SHELL, nested: bool = False) -> DataFrame:
    """payloads(id, json) with the canonical fields as columns, `route` and `problem`.

    events maps native event names to canonical ones; shell is the native name of the shell tool; with nested, the
    object `extra` gives what the payload lacks. route is the event that handles the payload, null for none.
    problem, the first of: not an object (or more than one value), extra (no object), type (event or tool name isn't a string),
    event (no name given), unsupported (an event that nothing handles).
    """
    j = F.col("json")
    extra = promoted(j, "extra", [])
    fields = {}
    for name in dict.fromkeys([*ALIASES, *(NESTED if nested else {})]):
        fields[name] = with_nested(j, extra, name, NESTED[name]) if nested and name in NESTED else promoted(j, name, ALIASES.get(name, []))
    value = F.try_parse_json(j)

    def other_type(name: str) -> Column:
        """Whether the value that counts is present and neither a string nor null."""
        types = [F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) for k in (name, *ALIASES[name])]
        return F.coalesce(~F.coalesce(*types).isin("STRING", "VOID"), F.lit(False))

    event, tool = canonical(fields["hook_event_name"], events or {}), canonical(fields["tool_name"], {shell: SHELL} if shell != SHELL else {})
    fields["hook_event_name"], fields["tool_name"] = event, tool
    problem = (
        F.when(~F.coalesce(single_object(j), F.lit(False)), "not an object").when(F.lit(nested) & extra.isNotNull() & F.json_object_keys(extra).isNull(), "extra")
        .when(other_type("hook_event_name") | other_type("tool_name"), "type").when(F.coalesce(event, F.lit("")) == "", "event").when(~event.isin(*EVENTS), "unsupported")
    )
    return payloads.select("id", *[c.alias(n) for n, c in fields.items()], F.when(problem.isNull(), event).alias("route"), problem.alias("problem"))

import json
import re

from pyspark.sql import functions as F

from loomwork.operators import ai


def test_what_models_were_asked(spark):
    bodies = [
        ({"model": "m", "messages": [{"role": "user", "content": "one"}, {"role": "user", "content": [{"type": "text", "text": "two  x"}, "three", {"input_text": "four"}, {"z": 1}]}, {"role": "assistant", "content": "no"}], "stream": True}, ("m", "two x three four", True)),
        ({"input": "a\n b", "model": 3}, (None, "a b", False)), ({"prompt": "p", "stream": "true"}, (None, "p", False)), ({"contents": [{"parts": [{"text": "g"}]}], "model": "g1"}, ("g1", "g", False)),
        ({"input": [{"content": "in list"}]}, (None, "in list", False)), ({"messages": [{"role": "system", "content": "only"}]}, (None, "only", False)), ({"input": "", "messages": [{"content": "m"}]}, (None, "m", False)),
        ({"messages": []}, (None, None, False)), ({"prompt": "w" * 500}, (None, "w" * 200, False)), ({}, (None, None, False)),
    ]
    rows = [(k, json.dumps(b)) for k, (b, _) in enumerate(bodies)] + [(90, "not json"), (91, None), (92, "[1]")]
    got = {r["k"]: tuple(r["d"]) for r in spark.createDataFrame(rows, "k int, b string").select("k", ai.request_details(F.col("b")).alias("d")).collect()}
    assert got == {**{k: w for k, (_, w) in enumerate(bodies)}, 90: (None, None, False), 91: (None, None, False), 92: (None, None, False)}


def in_turn(bodies):
    """Usage and answer, frame by frame."""
    usage, answer = [None, None], ""
    for body in bodies:
        try:
            found = [json.loads(body)]
        except ValueError:
            found = []
            for line in body.split("\n"):
                if line.startswith("data:"):
                    try:
                        found.append(json.loads(line[5:].strip()))
                    except ValueError:
                        pass
        for f in found:
            held = f.get("usage") or (f.get("response") or {}).get("usage") or (f.get("message") or {}).get("usage")
            pair = [held.get("input_tokens", held.get("prompt_tokens")), held.get("output_tokens", held.get("completion_tokens"))] if held else [None, None]
            if pair == [None, None] and (meta := f.get("usageMetadata")):
                pair = [meta.get("promptTokenCount"), meta.get("candidatesTokenCount")]
            usage = [p if p is not None else u for p, u in zip(pair, usage, strict=True)]
            choice = (f.get("choices") or [{}])[0]
            full = f.get("output_text") or (choice.get("message") or {}).get("content") or choice.get("text")
            full = full or next((x for x in f.get("content") or [] if isinstance(x, dict) and x.get("type") == "text"), {}).get("text")
            if isinstance(full, str):
                answer = full
            delta = (choice.get("delta") or {}).get("content") or (f.get("delta") if f.get("type") == "response.output_text.delta" else (f.get("delta") or {}).get("text") if f.get("type") == "content_block_delta" else None)
            if isinstance(delta, str) and len(answer) < 200:
                answer += delta
    return (*usage, re.sub(r"\s+", " ", answer).strip()[:200] if answer else None)


def test_answers_of_every_dialect(spark):
    piece = lambda n, d: {"choices": [{"delta": {"content": f"{d}{n} "}}]}
    calls = {
        "whole": [json.dumps({"choices": [{"message": {"content": "hi  there"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}})],
        "blocks": [json.dumps({"content": [{"type": "tool"}, {"type": "text", "text": "block"}], "usage": {"input_tokens": 1}})],
        "sse": ["event: a\ndata: " + json.dumps({"message": {"usage": {"input_tokens": 9}}}) + "\ndata: [DONE]\n\ndata:" + json.dumps({"type": "content_block_delta", "delta": {"text": "ab"}}), "data: " + json.dumps({"type": "content_block_delta", "delta": {"text": " cd"}, "usage": {"output_tokens": 7}})],
        "long": ["\n".join("data: " + json.dumps(piece(n, "d")) for n in range(900))], "replaced": ["data: " + json.dumps(piece(1, "old")), json.dumps({"output_text": "new"}), "data: " + json.dumps(piece(2, "+"))],
        "gemini": [json.dumps({"usageMetadata": {"promptTokenCount": 5, "candidatesTokenCount": 6}})], "responses": ["data: " + json.dumps({"type": "response.output_text.delta", "delta": "x"}), "data: " + json.dumps({"response": {"usage": {"input_tokens": 2, "output_tokens": 8}}})],
        "full": [json.dumps({"output_text": "f" * 300}), "data: " + json.dumps(piece(3, "n"))], "none": ["data: {}"],
    }
    rows = [(c, k, b) for c, bodies in calls.items() for k, b in enumerate(bodies)] + [("bad", 0, "nothing"), ("null", 0, None)]
    got = {r["call"]: tuple(r)[1:] for r in ai.response_details(ai.frames(spark.createDataFrame(rows, "call string, seq int, body string"))).collect()}
    assert got == {c: in_turn(b) for c, b in calls.items()}
    assert ai.response_details(ai.frames(spark.createDataFrame([], "call string, seq int, body string"))).count() == 0

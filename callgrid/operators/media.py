"""Media: WAV files from samples and their inspection, JSON envelopes and opaque binary frames."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

# fixed values: bytes of a recording, milliseconds of one, bytes of an envelope, a frame and a stream, last sequence, seconds of a stream
MAX_AUDIO_BYTES, MAX_MS, MAX_ENVELOPE_BYTES, MAX_FRAME_BYTES, MAX_STREAM_BYTES, MAX_SEQUENCE, MAX_STREAM_S = 100_000_000, 7_200_000, 150_000, 100_000, 100_000_000, 2_147_483_647, 7_200
RATE = 8000
#: Keys of each kind of envelope.
ENVELOPES = {"connected": ["event"], "start": ["event", "sequence_number", "start", "stream_sid"], "media": ["event", "media", "sequence_number", "stream_sid"], "stop": ["event", "sequence_number", "stop", "stream_sid"]}


def little_endian(n: Column, n_bytes: int) -> Column:
    digits = F.lpad(F.hex(n), 2 * n_bytes, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n_bytes))]))


def wav(pcm: Column, rate: int = RATE) -> Column:
    """A WAV file of one channel of 16-bit samples; null where there are none, half a sample or too many."""
    n = F.octet_length(pcm)
    fixed = lambda value, n_bytes: little_endian(F.lit(value), n_bytes)
    text = lambda t: F.encode(F.lit(t), "UTF-8")
    head = [text("RIFF"), little_endian(n + 36, 4), text("WAVEfmt "), fixed(16, 4), fixed(1, 2), fixed(1, 2), fixed(rate, 4), fixed(2 * rate, 4), fixed(2, 2), fixed(16, 2), text("data"), little_endian(n, 4)]
    return F.when((n > 0) & (n <= MAX_AUDIO_BYTES) & (n % 2 == 0), F.concat(*head, pcm))


def wav_properties(raw: bytes | None) -> tuple[int | None, int | None, int | None, str | None]:
    """rate, channels, milliseconds and fault of a WAV file."""
    if not raw or len(raw) > MAX_AUDIO_BYTES:
        return None, None, None, "SIZE"
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None, None, None, "FORMAT"
    at, form, data = 12, None, None
    while at + 8 <= len(raw) and data is None:
        name, size = struct.unpack_from("<4sI", raw, at)
        if name == b"fmt " and size >= 16 and at + 24 <= len(raw):
            form = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif name == b"data":
            data = (at + 8, size)
        at += 8 + size + size % 2
    if form is None or data is None:
        return None, None, None, "FORMAT"
    codec, channels, rate, _, _, bits = form
    frame = channels * (bits // 8)
    ms = round(data[1] // frame * 1000 / rate) if rate and frame else 0
    if codec != 1 or not 0 < channels <= 2 or not 0 < ms <= MAX_MS:
        return rate, channels, ms, "PROPERTIES"
    return rate, channels, ms, "TRUNCATED" if data[0] + data[1] > len(raw) else None


# fixed values of MPEG audio, layer III: kilobits a second by index (version 1; versions 2 and 2.5), samples a second by version and index
MP3_RATES = {1: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], 2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
MP3_SAMPLES = {3: [44_100, 48_000, 32_000], 2: [22_050, 24_000, 16_000], 0: [11_025, 12_000, 8_000]}


def mp3_frame(raw: bytes, at: int) -> tuple[int, int, int, int] | None:
    """Length, samples, rate and channels of the frame whose header stands there, or None."""
    if at + 4 > len(raw):
        return None
    h = int.from_bytes(raw[at : at + 4], "big")
    version, layer, rate_at, sample_at = h >> 19 & 3, h >> 17 & 3, h >> 12 & 15, h >> 10 & 3
    if h >> 21 != 0x7FF or version == 1 or layer != 1 or not 0 < rate_at < 15 or sample_at == 3:
        return None
    samples, rate = (1152 if version == 3 else 576), MP3_SAMPLES[version][sample_at]
    return samples // 8 * MP3_RATES[1 if version == 3 else 2][rate_at] * 1000 // rate + (h >> 9 & 1), samples, rate, 1 if h >> 6 & 3 == 3 else 2


def mp3_announced(raw: bytes, at: int) -> int | None:
    """Number of sound frames that a first frame's own tag announces (variable and constant rate)."""
    length, _, rate, channels = mp3_frame(raw, at)
    one = raw[at + 1] >> 3 & 3 == 3
    tag = at + 4 + (17 if channels == 1 else 32) if one else at + 4 + (9 if channels == 1 else 17)
    if raw[tag : tag + 4] in (b"Xing", b"Info") and raw[tag + 7 : tag + 8] and raw[tag + 7] & 1:
        return int.from_bytes(raw[tag + 8 : tag + 12], "big")
    if raw[at + 36 : at + 40] == b"VBRI":
        return int.from_bytes(raw[at + 50 : at + 54], "big")
    return -1 if raw[tag : tag + 4] in (b"Xing", b"Info") else None


def mp3_properties(raw: bytes | None) -> tuple[int | None, int | None, int | None, str | None]:
    """rate, channels, milliseconds and fault of an MP3 file, by a walk over its frame headers: tags before and
    after the sound are skipped, the time is that of the frames that are whole. TRUNCATED: fewer of them than
    its first frame announces, less 2, or a last one that the file's end cuts."""
    if not raw or len(raw) > MAX_AUDIO_BYTES:
        return None, None, None, "SIZE"
    at = 0
    while raw[at : at + 3] == b"ID3" and at + 10 <= len(raw):
        size = 0
        for b in raw[at + 6 : at + 10]:
            size = size << 7 | b & 127
        at += 10 + size + 10 * (raw[at + 5] >> 4 & 1)
    first = mp3_frame(raw, at)
    if first is None:
        return None, None, None, "FORMAT"
    announced = mp3_announced(raw, at)
    _, samples, rate, channels = first
    n, cut = 0, False
    if announced is not None:  # the first frame bears the tag, not sound
        at += first[0]
    while (frame := mp3_frame(raw, at)) is not None and frame[1:3] == (samples, rate):
        cut = at + frame[0] > len(raw)
        n += not cut
        at += frame[0]
    ms = round(n * samples * 1000 / rate)
    if not cut and at < len(raw) and raw[at : at + 3] != b"TAG" and raw[at : at + 8] != b"APETAGEX" and raw[at:].strip(b"\0"):
        return rate, channels, ms, "FORMAT"  # something else between or after the frames
    if not 0 < ms <= MAX_MS:
        return rate, channels, ms, "PROPERTIES"
    return rate, channels, ms, "TRUNCATED" if cut or announced is not None and n + 2 < announced else None


def audio_properties(raw: bytes | None) -> tuple[str | None, int | None, int | None, int | None, str | None]:
    """codec (wav, mp3 or null) and the properties of a file of either kind."""
    if raw and (raw[:3] == b"ID3" or len(raw) > 1 and raw[0] == 0xFF and raw[1] >> 5 == 7):
        return "mp3", *mp3_properties(raw)
    found = wav_properties(raw)
    return ("wav" if raw and raw[:4] == b"RIFF" else None), *found


def recordings(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every audio file below a path (those whose names match): path, modified, n_bytes, codec, rate,
    channels, duration_ms and fault; a file larger than may be is not read. Spark scans no empty files, so these
    have no row here; ``listing.listed`` shows them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    @F.pandas_udf("codec string, rate int, channels int, duration_ms int, fault string")
    def run(batch: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([audio_properties(x) for x in batch], columns=["codec", "rate", "channels", "duration_ms", "fault"])
        return out.astype({"rate": "Int32", "channels": "Int32", "duration_ms": "Int32"})

    small = files.filter(F.col("length") <= MAX_AUDIO_BYTES).withColumn("_p", run("content"))
    large = files.filter(F.col("length") > MAX_AUDIO_BYTES).withColumn("_p", F.lit(None).cast(small.schema["_p"].dataType))
    rows = small.drop("content").unionByName(large.drop("content"))
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("n_bytes"), "_p.codec", "_p.rate", "_p.channels", "_p.duration_ms", F.when(F.col("n_bytes") > MAX_AUDIO_BYTES, "SIZE").otherwise(F.col("_p.fault")).alias("fault"))


def inspected(files: Column) -> Column:
    """rate, channels, duration_ms and fault of WAV files."""

    @F.pandas_udf("rate int, channels int, duration_ms int, fault string")
    def run(batch: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([wav_properties(x) for x in batch], columns=["rate", "channels", "duration_ms", "fault"])
        return out.astype({"rate": "Int32", "channels": "Int32", "duration_ms": "Int32"})

    return run(files)


def envelopes(lines: DataFrame) -> DataFrame:
    """lines: value (one JSON envelope each) and any other columns. Adds kind, session, sequence, chunk,
    offset_ms, n_bytes of sound, and fault: null for an envelope that is well formed. The order of a
    session's envelopes is checked by what reads them next."""
    kind = F.get_json_object("value", "$.event")
    keys = F.array_sort(F.json_object_keys("value"))
    number = F.get_json_object("value", "$.sequence_number")
    rows = lines.withColumns({"kind": kind, "_keys": keys, "session": F.get_json_object("value", "$.stream_sid"), "_n": number, "_media": F.get_json_object("value", "$.media")})
    rows = rows.withColumns({"sequence": F.when(F.col("_n").rlike(r"^[0-9]{1,10}\z"), F.col("_n").cast("long")), "_inner": F.array_sort(F.json_object_keys("_media"))})
    for name, path in (("_chunk", "$.chunk"), ("_stamp", "$.timestamp"), ("_payload", "$.payload")):
        rows = rows.withColumn(name, F.get_json_object("_media", path))
    whole = (F.length("_payload") % 4 == 0) & F.col("_payload").rlike(r"^[A-Za-z0-9+/]*={0,2}\z")
    rows = rows.withColumns({"chunk": F.when(F.col("_chunk").rlike(r"^[0-9]{1,10}\z"), F.col("_chunk").cast("long")), "offset_ms": F.when(F.col("_stamp").rlike(r"^[0-9]{1,7}\z"), F.col("_stamp").cast("long")), "n_bytes": F.when(whole, F.octet_length(F.try_to_binary("_payload", F.lit("base64")))).cast("long")})
    wanted = F.create_map(*[x for k, v in ENVELOPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    fault = (
        F.when(F.octet_length("value") > MAX_ENVELOPE_BYTES, "TOO_LARGE")
        .when(F.col("_keys").isNull(), "NOT_JSON")
        .when(F.col("kind").isNull() | ~F.map_contains_key(wanted, F.coalesce("kind", F.lit(""))), "KIND")
        .when(F.try_element_at(wanted, F.col("kind")) != F.col("_keys"), "FIELDS")
        .when((F.col("kind") != "connected") & ~F.coalesce(F.col("sequence").between(1, MAX_SEQUENCE), F.lit(False)), "SEQUENCE")
        .when((F.col("kind") == "media") & ~F.coalesce(F.col("_inner") == F.array(F.lit("chunk"), F.lit("payload"), F.lit("timestamp")), F.lit(False)), "FIELDS")
        .when((F.col("kind") == "media") & ~F.coalesce(F.col("chunk").between(1, MAX_SEQUENCE), F.lit(False)), "CHUNK")
        .when((F.col("kind") == "media") & ~F.coalesce(F.col("offset_ms") <= MAX_MS, F.lit(False)), "TIMESTAMP")
        .when((F.col("kind") == "media") & ~F.coalesce((F.col("n_bytes") > 0) & (F.col("n_bytes") <= MAX_FRAME_BYTES) & (F.col("n_bytes") % 2 == 0), F.lit(False)), "PAYLOAD")
    )
    return rows.withColumn("fault", fault).drop("_keys", "_n", "_media", "_inner", "_chunk", "_stamp", "_payload")


def opaque_frames(frames: DataFrame) -> DataFrame:
    """frames: session_id, event_id, us, n_bytes. Adds status: OK, FRAME (empty or too large), TOO_LONG (too
    late after the session's first frame), STREAM (too many bytes in all) or CLOSED (after any of these)."""
    along = Window.partitionBy("session_id").orderBy("us", "event_id")
    rows = frames.withColumns({"_since": F.col("us") - F.first("us").over(along), "_sum": F.sum("n_bytes").over(along.rowsBetween(Window.unboundedPreceding, 0))})
    status = F.when(~F.coalesce(F.col("n_bytes").between(1, MAX_FRAME_BYTES), F.lit(False)), "FRAME").when(F.col("_since") > MAX_STREAM_S * 1_000_000, "TOO_LONG").when(F.col("_sum") > MAX_STREAM_BYTES, "STREAM").otherwise("OK")
    rows = rows.withColumn("_own", status)
    broken = F.max((F.col("_own") != "OK").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("status", F.when(F.coalesce(broken, F.lit(0)) == 1, "CLOSED").otherwise(F.col("_own"))).drop("_since", "_sum", "_own")


#: Fields that a start envelope's inner object and its media format may have.
START_FIELDS, FORMAT_FIELDS = ["stream_sid", "call_sid", "account_sid", "media_format", "from", "to", "custom_parameters"], ["encoding", "sample_rate", "bit_rate", "channels"]
#: Values of a media format: encodings, samples a second, bits, channels.
ENCODINGS, SAMPLE_RATES, BIT_RATES, CHANNELS = ["raw", "slin", "base64"], ["8000"], ["16", "128kbps"], ["1"]
MAX_NAME, MAX_PARAMETERS = 256, 3


def session_lines(lines: DataFrame) -> DataFrame:
    """``envelopes`` with what a session needs besides: call and account (of a start or stop), own_fields
    (whether the envelope has its kind's fields), inner_session (of a start), start_fault (FIELDS, FORMAT or
    null) and numbered_chunk (whether the chunk is a JSON number)."""
    rows = envelopes(lines).withColumns({"_start": F.get_json_object("value", "$.start"), "_stop": F.get_json_object("value", "$.stop"), "_keys": F.array_sort(F.json_object_keys("value"))})
    inner = lambda name: F.get_json_object(F.coalesce("_start", "_stop"), f"$.{name}")
    part = lambda name: F.get_json_object("_start", f"$.{name}")
    short = lambda c: F.coalesce(F.char_length(c).between(1, MAX_NAME), F.lit(False))
    within = lambda obj, names: F.size(F.array_except(F.json_object_keys(obj), F.array(*map(F.lit, names)))) == 0
    form, custom = part("media_format"), part("custom_parameters")
    # a text in a JSON object, as against a number or an object
    is_text = lambda name: F.coalesce(F.col("_start").rlike(rf'"{name}":"'), F.lit(False))
    party = lambda name: part(name).isNull() & ~F.col("_start").contains(f'"{name}":') | is_text(name) & (F.char_length(part(name)) <= MAX_NAME)
    texts = F.from_json(custom, "map<string,string>")
    fine_custom = custom.isNull() | F.coalesce(
        (F.size(F.json_object_keys(custom)) <= MAX_PARAMETERS)
        & ~custom.rlike(r'":\s*[^"\s]')
        & (F.aggregate(F.map_entries(texts), F.lit(0), lambda n, e: n + F.char_length(e["key"]) + F.char_length(e["value"])) <= MAX_NAME),
        F.lit(False),
    )
    one_of = lambda name, values, needed: F.coalesce(F.get_json_object(form, f"$.{name}").isin(values), F.lit(not needed) & F.get_json_object(form, f"$.{name}").isNull())
    fields = F.coalesce(within("_start", START_FIELDS), F.lit(False)) & short(F.col("session")) & short(part("stream_sid")) & party("from") & party("to") & fine_custom
    formed = F.coalesce(within(form, FORMAT_FIELDS), F.lit(False)) & one_of("encoding", ENCODINGS, True) & one_of("sample_rate", SAMPLE_RATES, True) & one_of("channels", CHANNELS, False) & one_of("bit_rate", BIT_RATES, False)
    wanted = F.create_map(*[x for k, v in ENVELOPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return rows.withColumns({
        "call": inner("call_sid"),
        "account": inner("account_sid"),
        "inner_session": part("stream_sid"),
        "own_fields": F.coalesce(F.try_element_at(wanted, F.col("kind")) == F.col("_keys"), F.lit(False)),
        "start_fault": F.when(F.col("kind") == "start", F.when(~fields, "FIELDS").when(~formed, "FORMAT")),
        "numbered_chunk": F.coalesce(F.get_json_object("value", "$.media").rlike(r'"chunk":[0-9]+[,}]'), F.lit(False)),
    }).drop("_start", "_stop", "_keys")

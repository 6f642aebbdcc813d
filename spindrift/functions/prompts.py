"""Prompts of evaluation tasks (X14): a table of templates whose slots are filled by expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording that models are asked with. {question} and {options} are slots.
_LOOK = "{question}\nPlease answer this question based on the visual content. "
_POINTS = (
    "Choose informative points that help distinguish object vs. background. Prefer negatives on clear non-object "
    "pixels INSIDE the box when safe; otherwise place them just outside on obvious background. "
    "Negatives must NEVER be on the object or on its boundary.\n"
)
_TAGS = " within <answer>...</answer> tags. Example: "
TEMPLATES = {
    "video_qa": "{question}\nOptions:\n{options}\nAnswer with the option letter only" + _TAGS + "<answer>A</answer>",
    "video_qa_explicit": (
        "{question}\nOptions:\n{options}\nThere are 8 options, A through H. Answer with exactly one option "
        "letter from A, B, C, D, E, F, G, H" + _TAGS + "<answer>H</answer>"
    ),
    "video_qa_careful": (
        "{question}\nOptions:\n{options}\nCarefully watch the video and compare all options. The correct answer "
        "may be any option from A, B, C, D, E, F, G, or H. Do not favor earlier "
        "options. Answer with exactly one option letter" + _TAGS + "<answer>G</answer>"
    ),
    "space_choice": "{question}\n{options}\nAnswer with the option letter" + _TAGS + "<answer>A</answer>",
    "space_integer": "{question}\nAnswer with an integer" + _TAGS + "<answer>3</answer>",
    "space_meters": "{question}\nAnswer with a number in meters" + _TAGS + "<answer>2.3</answer>",
    "space_centimeters": "{question}\nAnswer with a number in centimeters" + _TAGS + "<answer>120.5</answer>",
    "space_square_meters": "{question}\nAnswer with a number in square meters" + _TAGS + "<answer>25.5</answer>",
    "image_choice": (
        "{question}\nChoose the best answer from the options. Put exactly one uppercase option letter inside <answer>...</answer> "
        "Do not explain. Example: <answer>A</answer>"
    ),
    "tracking": _LOOK + (
        "Please track the target object throughout the video and provide one bounding box per second, "
        "ONLY up to 32 seconds, within the <answer>...</answer> tags.\nExample:\n"
        '<answer>{"boxes": {"1": [405, 230, 654, 463], "2": [435, 223, 678, 446], "32": [415, 203, 691, 487]}}</answer>\n'
        "Note: Each key in 'boxes' must correspond to a second (1, 2, 3, ..., 32) and contain a 4-number bounding box [x1, y1, x2, y2]."
    ),
    "tubes": _LOOK.replace("{question}", (
        'Given the query "{question}", when and where does the described content occur in the video? please firstly give the '
        "start and end time, spatial bounding box corresponding to each integer second."
    )) + (
        "Please provide only the time span in seconds and bounding boxes as JSON within the <answer>...</answer> tags.\n"
        "You MUST output one bounding box for every integer second within the given time span (inclusive).\nExample:\n"
        '<answer>{"time": [8.1, 13.5], "boxes": {"9": [317, 422, 582, 997], "10": [332, 175, 442, 369], "11": [340, 180, 450, 370]}}</answer>\n'
        "Note: Each key in 'boxes' must be an integer second within the span, and its value must be a 4-number bounding box [x1, y1, x2, y2]."
    ),
    "segmentation_image": _LOOK + (
        "This task prepares inputs for image object segmentation with a specialized model (e.g., SAM2).\n"
        "Please provide ONE bounding box, 3 positive points (clearly INSIDE the object), "
        "and 3 negative points (clearly OUTSIDE the object) within the <answer>...</answer> tags.\n" + _POINTS +
        'Example: <answer>{"boxes": [x1, y1, x2, y2], "positive_points": [[x,y],[x,y],[x,y]], "negative_points": [[x,y],[x,y],[x,y]]}</answer>'
    ),
    "segmentation_video": _LOOK + (
        "This task prepares inputs for video object segmentation with a specialized model (e.g., SAM2).\n"
        "Please select ONE representative time (in seconds), and provide ONE bounding box, "
        "3 positive points (clearly INSIDE the object), and 3 negative points (clearly OUTSIDE the object) "
        "within the <answer>...</answer> tags.\n" + _POINTS +
        'Example: <answer>{"time": <time_in_seconds>, "boxes": [x1, y1, x2, y2], '
        '"positive_points": [[x,y],[x,y],[x,y]], "negative_points": [[x,y],[x,y],[x,y]]}</answer>'
    ),
    "spatial_grounding": (
        'Locate "{question}" in the image. Output its bounding box in JSON format within <answer>...</answer> tags. '
        'Example: <answer>[{"bbox_2d": [123, 30, 404, 846]}]</answer>'
    ),
    "temporal_grounding": (
        'To accurately pinpoint the event "{question}" in the video, determine the precise time period of the event. '
        'Provide the start and end times (in seconds) in the format "start time to end time" within <answer> </answer> tags. '
        "Example: <answer> 12 to 18 </answer>"
    ),
    "temporal_grounding_official": (
        "Please find the visual event described by the sentence '{question}', determining its starting and ending times. "
        "The format should be: 'The event happens in <start time> - <end time> seconds'."
    ),
}
# The template of a numeric spatial question by its type.
MEASURES = {
    "object_counting": "space_integer", "object_abs_distance": "space_meters", "object_size_estimation": "space_centimeters",
    "room_size_estimation": "space_square_meters",
}


def fill(template: Column | str, question: Column, options: Column | None = None) -> Column:
    """A prompt: the template of a name with its slots filled; options are lines, none leave an empty line.

    A name that is not in the table stops the query. Slots in the question itself stay as they are.
    """
    name = F.lit(template) if isinstance(template, str) else template
    table = F.create_map(*[F.lit(x) for pair in TEMPLATES.items() for x in pair])
    text = F.coalesce(F.try_element_at(table, name), F.raise_error(F.concat(F.lit("there is no prompt template "), name)).cast("string"))
    parts = F.split(text, r"\{question\}", 2)
    listed = F.coalesce(F.array_join(options, "\n"), F.lit("")) if options is not None else F.lit("")
    tail = F.replace(F.get(parts, F.lit(1)), F.lit("{options}"), listed)
    return F.concat(F.get(parts, F.lit(0)), F.coalesce(question, F.lit("")), tail)


def sentence(text: Column) -> Column:
    """A referring expression as a sentence: trimmed, with a full stop unless it ends like one; empty stays empty."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.when((bare == "") | bare.rlike(r"[.?!]$"), bare).otherwise(F.concat(bare, F.lit(".")))

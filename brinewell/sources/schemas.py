"""Record schemas."""

from __future__ import annotations

POST = (
    "id string, subreddit string, title string, body string, permalink string, provider string, score bigint, comment_count bigint, score_at_fetch bigint, upvote_ratio double, "
    "created_at timestamp, fetched_at timestamp, external_url string, domain string, flair string, crosspost_parent string, is_self boolean, is_nsfw boolean, is_stickied boolean, "
    "is_locked boolean, is_crosspost boolean, post_type string, removed_state string"
)
COMMENT = "id string, post_id string, parent_id string, body string, score bigint, created_at timestamp, depth bigint, is_submitter boolean, removed_state string, reply_count bigint, provider string, fetched_at timestamp"
#: A post as a web API returns it; numbers and instants come as text, so that each rule below decides on them.
RAW_POST = (
    "id string, subreddit string, title string, selftext string, permalink string, score string, num_comments string, comment_count string, upvote_ratio string, created_utc string, url string, "
    "domain string, link_flair_text string, crosspost_parent string, crosspost_parent_id string, post_hint string, is_self boolean, over_18 boolean, stickied boolean, locked boolean"
)
CLASSIFICATION = "post_id string, relevance bigint, value bigint, kind string, skip boolean, skip_reason string"

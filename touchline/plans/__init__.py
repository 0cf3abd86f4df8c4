from . import catalog, dataset_queries, download_queries, event_queries, file_queries, frame_queries, picture_queries, relational, role_queries, scoring_queries, split_queries, window_queries  # noqa: F401  each registers its queries

"""Training-data operators: secrets, quality, token counts, licences, mixing, media, language models, near-duplicates,
language identification, benchmark decontamination, periodic runs, conversation repair and main texts of pages."""

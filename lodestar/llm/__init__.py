"""Operations for training-data pipelines over text; nothing outside this subpackage imports it."""

"""karyospark: paired-sample copy-number analytics as PySpark DataFrame operators."""

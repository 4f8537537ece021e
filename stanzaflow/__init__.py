"""stanzaflow: a Spark-native engine for analysing annotated text corpora.

``functions`` holds Column -> Column expressions, ``operators`` DataFrame -> DataFrame operators,
``sources`` scans and sinks, ``streaming`` incremental forms, ``plans`` the query catalogue and the stage graph.
"""

from strandline.llm import licenses

ROWS = [
    (1, "prose here\nLicensed under the Apache License, Version 2.0.\nmore"),
    (2, "Some words. licensed under the GNU General Public License, version 3. And more words after it."),
    (3, "Licensed under CC BY-NC 4.0."),
    (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    (5, "He lost his license on the way to the market, and no permission was given."),
    (6, None),
    (7, ""),
    (8, "nothing of the kind"),
    (9, "The copyright of the song was sold."),
    (None, "Licensed under the MIT License."),
    (3, "Licensed under CC BY-NC 4.0."),
    (10, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n" + "x " * 20000 + "\nLicensed under CC BY-SA 4.0."),
]
WANT = {1: "apache", 2: "gpl", 3: "cc-by-nc", 4: "mit", 5: "", 6: "", 7: "", 8: "", 9: "", None: "mit", 10: "bsd,cc-by-sa"}


def test_families(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in ROWS], "doc_id long, text string, family string")
    got = licenses.scan(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: r.families for r in got} == WANT, [(r.doc_id, r.n_predicted, r.families, r.least_probability) for r in got]


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0

"""Fixed values of the licence scan: base phrases, labels and templates."""

# Phrases that must be found and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notice templates (label, text, mandatory key phrases).
LICENCE_TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published"
            " by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
     ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation",
     ["gnu affero general public license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
                 " associated documentation files", ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use in source and binary forms"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"]),
    ("cc-by", "this text is available under cc by 4 0", ["cc by"]),
    ("cc-by-sa", "this text is available under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "this text is available under cc by nc 4 0", ["cc by nc"]),
    ("cc0", "released under cc0 1 0 universal public domain dedication", ["public domain dedication"]),
    ("all-rights-reserved", "copyright all rights reserved", ["all rights reserved"]),
]

"""What licences are known by: names, notices, and paragraphs of the licence texts.

Identifiers are those of the SPDX list, without -only and -or-later, which notices rarely tell apart.
Creative Commons names, and the one-line notices of every name, are made by rules.
"""

from __future__ import annotations

# Names of licences as notices give them.
NAMES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "AFL-3.0": ["Academic Free License, version 3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"],
    "Apache-1.1": ["Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "Artistic-1.0": ["Artistic License, version 1.0"],
    "Artistic-2.0": ["Artistic License, version 2.0", "Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "Original BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 1.0"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0"],
    "ECL-2.0": ["Educational Community License, Version 2.0"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"],
    "EUPL-1.2": ["European Union Public Licence, Version 1.2", "EUPL 1.2"],
    "GFDL-1.2": ["GNU Free Documentation License, Version 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3"],
    "GPL-1.0": ["GNU General Public License, version 1"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-2.0": ["GNU Library General Public License, version 2"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL v3", "LGPLv3"],
    "MIT": ["MIT License", "MIT/X11 License", "Expat License"],
    "MIT-0": ["MIT No Attribution License"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    "MS-PL": ["Microsoft Public License"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"],
    "PostgreSQL": ["PostgreSQL License"],
    "Python-2.0": ["Python Software Foundation License Version 2"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}
# The parts of a Creative Commons licence's name.
CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
CC_KINDS = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
CC_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}
# Titles, notices for source files, and paragraphs by which the texts of licences differ.
TEXTS = {
    "AGPL-3.0": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3, as published by the Free Software Foundation.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ],
    "Apache-1.1": ["The Apache Software License, Version 1.1", "This product includes software developed by the Apache Software Foundation (http://www.apache.org/)."],
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "Artistic-2.0": ["The Artistic License 2.0", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control over the development of that Package while still keeping the Package available as open source and free software."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD 2-clause license that can be found in the LICENSE file.",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-4-Clause": ["All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."],
    "BSL-1.0": [
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under the CC0 1.0 Universal Public Domain Dedication."],
    "CDDL-1.0": ["COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."],
    "EPL-1.0": ["Eclipse Public License - v 1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EUPL-1.2": ["EUROPEAN UNION PUBLIC LICENCE v. 1.2 EUPL (c) the European Union 2007, 2016", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."],
    "GFDL-1.2": ["GNU Free Documentation License Version 1.2, November 2002"],
    "GFDL-1.3": [
        "GNU Free Documentation License Version 1.3, 3 November 2008",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    ],
    "GPL-1.0": ["GNU GENERAL PUBLIC LICENSE Version 1, February 1989"],
    "GPL-2.0": [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it. (Some other Free Software Foundation software is covered by the GNU Lesser General Public License instead.) You can apply it to your programs, too.",
    ],
    "GPL-3.0": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "LGPL-2.0": [
        "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.",
    ],
    "LGPL-3.0": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ],
    "MIT": [
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT.",
    ],
    "MIT-0": ["MIT No Attribution"],
    "MPL-1.1": ["MOZILLA PUBLIC LICENSE Version 1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ],
    "MS-PL": ["Microsoft Public License (Ms-PL)", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."],
    "OFL-1.1": ["SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: https://openfontlicense.org"],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "Python-2.0": ["PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
}
#: Licences whose texts hold those of others: with both in a file, the first name counts.
REFINES = {"BSD-3-Clause": {"BSD-2-Clause"}, "BSD-4-Clause": {"BSD-2-Clause", "BSD-3-Clause"}, "LGPL-3.0": {"GPL-3.0"}, "AGPL-3.0": {"GPL-3.0"}, "LGPL-2.1": {"LGPL-2.0"}, "MIT-0": {"MIT"}, "ISC": {"0BSD"}}
#: Words that tell near licences apart: a segment has to have the same ones as a template.
DECIDING = "affero lesser documentation nc nd sa noncommercial sharealike noderivatives".split()
NOTICES = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "Licensed under {}.")


def templates() -> list[tuple[str, str]]:
    """(identifier, text) of all notices, titles and paragraphs."""
    names = {k: list(v) for k, v in NAMES.items()}
    for kind in CC_KINDS:
        for version, scope in CC_VERSIONS.items():
            long = "-".join(CC_PARTS[p] for p in kind.split("-"))
            names[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", f"Creative Commons {long} {version} {scope} License", f"Creative Commons {long} {version}"]
    made = [(k, notice.format(name)) for k, own in names.items() for name in own for notice in NOTICES]
    made += [(k, name) for k, own in names.items() for name in own if len(name.split()) > 1]
    return sorted({*made, *((k, t) for k, texts in TEXTS.items() for t in texts)})
